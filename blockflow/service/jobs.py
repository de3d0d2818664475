"""Scheduled tasks and their runs, kept in a SQLite file; due tasks run as child processes."""

from __future__ import annotations

import logging
import shlex
import sqlite3
import subprocess
import sys
import threading
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from .schedule import parse

log = logging.getLogger("blockflow.service")
#: Seconds between looks for due tasks.
POLL = 5.0
TASK_FIELDS = ("name", "schedule", "repository", "command", "args", "is_script", "enabled", "coalesce")
_TABLES = """
CREATE TABLE IF NOT EXISTS repositories (id integer PRIMARY KEY, name text UNIQUE NOT NULL, remote_url text, local_path text, last_commit_hash text, last_commit_message text, last_commit_date text, last_commit_author text);
CREATE TABLE IF NOT EXISTS tasks (id integer PRIMARY KEY, created_at text NOT NULL, updated_at text NOT NULL, name text UNIQUE NOT NULL, schedule text NOT NULL, repository text, command text NOT NULL, args text NOT NULL DEFAULT '', is_script integer NOT NULL DEFAULT 0, enabled integer NOT NULL DEFAULT 1, coalesce integer NOT NULL DEFAULT 1, next_run text);
CREATE TABLE IF NOT EXISTS invocations (id integer PRIMARY KEY, task_id integer NOT NULL REFERENCES tasks (id) ON DELETE CASCADE, scheduled_to_start_at text, started_at text, finished_at text, success integer, error_message text NOT NULL DEFAULT '', log text NOT NULL DEFAULT '');
CREATE INDEX IF NOT EXISTS invocation_times ON invocations (task_id, scheduled_to_start_at);
"""


def now() -> datetime:
    return datetime.now(UTC).replace(microsecond=0)


class Registry:
    """Tables tasks, invocations and repositories. One connection, one writer at a time."""

    def __init__(self, file: str):
        self.link = sqlite3.connect(file, check_same_thread=False, isolation_level=None)
        self.link.row_factory = sqlite3.Row
        self.guard = threading.RLock()
        self.link.executescript("PRAGMA foreign_keys = ON;" + _TABLES)

    def rows(self, sql: str, *args) -> list[dict]:
        with self.guard:
            return [dict(r) for r in self.link.execute(sql, args).fetchall()]

    def change(self, sql: str, *args) -> int:
        with self.guard:
            done = self.link.execute(sql, args)
            return done.lastrowid if sql.lstrip()[:6].upper() == "INSERT" else done.rowcount

    def task(self, key: int) -> dict:
        found = self.rows("SELECT * FROM tasks WHERE id = ?", key)
        if not found:
            raise KeyError(f"no task {key}")
        return found[0]

    def create_task(self, at: datetime | None = None, **given) -> dict:
        if missing := {"name", "schedule", "command"} - {k for k, v in given.items() if v}:
            raise ValueError(f"a task needs {', '.join(sorted(missing))}")
        own = {k: given[k] for k in TASK_FIELDS if k in given}
        at = at or now()
        own |= {"created_at": at.isoformat(), "updated_at": at.isoformat(), "next_run": parse(own["schedule"]).after(at).isoformat()}
        return self.task(self.change(f"INSERT INTO tasks ({', '.join(own)}) VALUES ({', '.join('?' * len(own))})", *own.values()))

    def update_task(self, key: int, at: datetime | None = None, **given) -> dict:
        at = at or now()
        own = {k: given[k] for k in TASK_FIELDS if k in given} | {"updated_at": at.isoformat()}
        if "schedule" in own or own.get("enabled"):
            own["next_run"] = parse(own.get("schedule") or self.task(key)["schedule"]).after(at).isoformat()
        if not self.change(f"UPDATE tasks SET {', '.join(f'{k} = ?' for k in own)} WHERE id = ?", *own.values(), key):
            raise KeyError(f"no task {key}")
        return self.task(key)

    def invocations(self, task: int | None = None, last: int | None = None) -> list[dict]:
        where, args = ("WHERE task_id = ?", [task]) if task is not None else ("", [])
        return self.rows(f"SELECT * FROM invocations {where} ORDER BY started_at DESC, id DESC LIMIT ?", *args, -1 if last is None else last)


class Scheduler:
    """Starts what is due. A task has one run at a time; with coalesce, runs missed meanwhile become one, else each is made up for."""

    def __init__(self, registry: Registry, folder: str = ".", run: Callable[[dict], tuple[bool, str]] | None = None):
        self.registry, self.folder, self.run = registry, Path(folder), run or self.child
        self.running: dict[int, threading.Thread] = {}
        self.children: dict[int, subprocess.Popen] = {}
        self.stopped = threading.Event()

    def command(self, task: dict) -> list[str]:
        if task["is_script"]:
            return [sys.executable, "-m", "blockflow.cli", "run", "--script", task["command"], *shlex.split(task["args"] or "")]
        return [*shlex.split(task["command"]), *shlex.split(task["args"] or "")]

    def child(self, task: dict) -> tuple[bool, str]:
        where = self.folder / task["repository"] if task["repository"] else self.folder
        child = subprocess.Popen(self.command(task), cwd=where, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
        self.children[task["id"]] = child
        try:
            out, _ = child.communicate()
            return child.returncode == 0, out
        finally:
            self.children.pop(task["id"], None)

    def next(self, at: datetime | None = None) -> list[int]:
        """Starts the tasks that are due at a time and not running; gives their ids."""
        at = at or now()
        started = []
        for task in self.registry.rows("SELECT * FROM tasks WHERE enabled AND next_run <= ? ORDER BY next_run", at.isoformat()):
            if (own := self.running.get(task["id"])) and own.is_alive():
                continue
            due = datetime.fromisoformat(task["next_run"])
            following = parse(task["schedule"]).after(at if task["coalesce"] else due)
            self.registry.change("UPDATE tasks SET next_run = ? WHERE id = ?", following.isoformat(), task["id"])
            self.running[task["id"]] = thread = threading.Thread(target=self._one, args=(task, due), daemon=True)
            thread.start()
            started.append(task["id"])
        return started

    def _one(self, task: dict, due: datetime) -> None:
        key = self.registry.change("INSERT INTO invocations (task_id, scheduled_to_start_at, started_at) VALUES (?, ?, ?)", task["id"], due.isoformat(), now().isoformat())
        error = out = ""
        try:
            good, out = self.run(task)
            error = "" if good else (out.strip().splitlines() or ["failed"])[-1]
        except Exception as e:  # a task that cannot be started is a failed run
            good, error = False, str(e)
        self.registry.change("UPDATE invocations SET finished_at = ?, success = ?, error_message = ?, log = ? WHERE id = ?", now().isoformat(), int(good), error, out, key)
        log.log(logging.INFO if good else logging.ERROR, "%s %s", task["name"], "succeeded" if good else f"failed: {error}")

    def stop_task(self, key: int) -> None:
        if child := self.children.get(key):
            child.terminate()

    def wait(self) -> None:
        for t in list(self.running.values()):
            t.join()

    def forever(self, poll: float = POLL) -> None:
        while not self.stopped.wait(poll):
            try:
                self.next()
            except Exception as e:  # the next look may fare better
                log.error("scheduler: %s", e)
