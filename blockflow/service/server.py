"""python -m blockflow.service.server [--file jobs.db] [--folder .] [--port 4040]: tasks, runs and repositories over HTTP."""

from __future__ import annotations

import argparse
import io
import json
import logging
import re
import shutil
import sqlite3
import subprocess
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from ..plans.engine import job
from .jobs import Registry, Scheduler


def _git(folder: Path | str, *args: str) -> str:
    done = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True)
    if done.returncode:
        raise ValueError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout.strip()


class Service:
    """What the routes do. Scripts sent to /compile and /run are checked or run here, with their console output as the answer."""

    def __init__(self, registry: Registry, scheduler: Scheduler, session: Callable[[], SparkSession]):
        self.registry, self.scheduler, self.session = registry, scheduler, session
        self.routes: list[tuple[str, str, Callable]] = [
            ("GET", "/tasks", lambda _: registry.rows("SELECT * FROM tasks ORDER BY name")),
            ("POST", "/tasks", lambda body: registry.create_task(**body)),
            ("GET", r"/tasks/(\d+)", lambda _, k: registry.task(k)),
            ("PUT", r"/tasks/(\d+)", lambda body, k: registry.update_task(k, **body)),
            ("DELETE", r"/tasks/(\d+)", self.delete_task),
            ("PUT", r"/tasks/(\d+)/enable", lambda _, k: registry.update_task(k, enabled=1)),
            ("PUT", r"/tasks/(\d+)/disable", self.disable),
            ("GET", r"/tasks/(\d+)/invocations", lambda _, k: registry.invocations(k)),
            ("GET", r"/tasks/(\d+)/last-invocation", lambda _, k: (registry.invocations(k, 1) or [None])[0]),
            ("GET", "/invocations", lambda _: registry.invocations()),
            ("GET", "/repositories", lambda _: registry.rows("SELECT * FROM repositories ORDER BY name")),
            ("POST", "/repositories", self.clone),
            ("POST", r"/repositories/(\d+)/update", self.pull),
            ("GET", r"/repositories/(\d+)/files", lambda _, k: _git(self.repository(k)["local_path"], "ls-files").splitlines()),
            ("DELETE", r"/repositories/(\d+)", self.delete_repository),
            ("POST", "/compile", lambda body: self.script(body, "validate")),
            ("POST", "/run", lambda body: self.script(body, "run")),
        ]

    def answer(self, method: str, path: str, body: dict) -> tuple[int, object]:
        for verb, pattern, act in self.routes:
            if verb == method and (m := re.fullmatch(pattern, path.rstrip("/"))):
                try:
                    return 200, act(body, *map(int, m.groups()))
                except KeyError as e:
                    return 404, {"error": str(e.args[0])}
                except Exception as e:  # what the caller asked for could not be done
                    return 400, {"error": str(e)}
        return 404, {"error": f"no {method} {path}"}

    def disable(self, body: dict, key: int) -> dict:
        out = self.registry.update_task(key, enabled=0)
        self.scheduler.stop_task(key)
        return out

    def delete_task(self, body: dict, key: int) -> dict:
        self.scheduler.stop_task(key)
        if not self.registry.change("DELETE FROM tasks WHERE id = ?", key):
            raise KeyError(f"no task {key}")
        return {"deleted": key}

    def repository(self, key: int) -> dict:
        found = self.registry.rows("SELECT * FROM repositories WHERE id = ?", key)
        if not found:
            raise KeyError(f"no repository {key}")
        return found[0]

    def clone(self, body: dict) -> dict:
        name = str(body.get("name", ""))
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith("."):
            raise ValueError("a repository needs a plain name")
        where = self.scheduler.folder / name
        _git(self.scheduler.folder, "clone", "--", str(body["remote_url"]), str(where.resolve()))
        try:
            key = self.registry.change("INSERT INTO repositories (name, remote_url, local_path) VALUES (?, ?, ?)", name, body["remote_url"], str(where.resolve()))
        except sqlite3.Error:
            shutil.rmtree(where)
            raise
        return self.noted(key)

    def noted(self, key: int) -> dict:
        last = _git(self.repository(key)["local_path"], "log", "-1", "--format=%H%x00%s%x00%cI%x00%an").split("\0")
        self.registry.change("UPDATE repositories SET last_commit_hash = ?, last_commit_message = ?, last_commit_date = ?, last_commit_author = ? WHERE id = ?", *last, key)
        return self.repository(key)

    def pull(self, body: dict, key: int) -> dict:
        _git(self.repository(key)["local_path"], "pull", "--ff-only")
        return self.noted(key)

    def delete_repository(self, body: dict, key: int) -> dict:
        shutil.rmtree(self.repository(key)["local_path"], ignore_errors=True)
        self.registry.change("DELETE FROM repositories WHERE id = ?", key)
        return {"deleted": key}

    def script(self, body: dict, mode: str) -> dict:
        out = io.StringIO()
        job(self.session(), body["script"], mode=mode, params=body.get("params") or {}, base=self.scheduler.folder, out=out).execute()
        return {"output": out.getvalue()}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _any(self) -> None:
            text = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                code, out = service.answer(self.command, self.path.partition("?")[0], json.loads(text or b"{}"))
            except ValueError as e:
                code, out = 400, {"error": str(e)}
            data = json.dumps(out).encode()
            self.send_response(code)
            for k, v in (("Content-Type", "application/json"), ("Content-Length", str(len(data)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _any

        def log_message(self, form: str, *args: object) -> None:
            logging.getLogger("blockflow.service").debug(form, *args)

    return Handler


def serve(file: str, folder: str, port: int, host: str = "127.0.0.1") -> tuple[ThreadingHTTPServer, Scheduler]:
    """A server, ready for serve_forever(), and its scheduler, which already looks for due tasks."""
    from ..runtime.session import session

    registry = Registry(file)
    scheduler = Scheduler(registry, folder)
    threading.Thread(target=scheduler.forever, daemon=True).start()
    return ThreadingHTTPServer((host, port), handler(Service(registry, scheduler, session))), scheduler


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--file", default="jobs.db")
    p.add_argument("--folder", default=".")
    p.add_argument("--port", type=int, default=4040)
    p.add_argument("--host", default="127.0.0.1")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    serve(a.file, a.folder, a.port, a.host)[0].serve_forever()


if __name__ == "__main__":
    main()
