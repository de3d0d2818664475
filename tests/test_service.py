import json
import subprocess
import sys
import threading
from datetime import UTC, datetime, timedelta
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from blockflow.service.jobs import Registry, Scheduler
from blockflow.service.schedule import parse
from blockflow.service.server import Service, handler


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


@pytest.mark.parametrize(
    ("schedule", "start", "want"),
    [
        ("0 */15 * * * *", "2024-01-01T00:00:00", "2024-01-01T00:15:00"),
        ("30 5 4 * * *", "2024-02-28T04:05:30", "2024-02-29T04:05:30"),
        ("0 0 0 29 2 *", "2024-03-01T00:00:00", "2028-02-29T00:00:00"),
        ("0 0 12 * * mon-fri", "2024-06-07T12:00:00", "2024-06-10T12:00:00"),
        ("0 0 0 13 * fri", "2024-06-01T00:00:00", "2024-06-07T00:00:00"),
        ("0 30 8-10/2 1,15 jan,jul ?", "2024-01-01T08:30:00", "2024-01-01T10:30:00"),
        ("@daily", "2024-12-31T10:00:00", "2025-01-01T00:00:00"),
        ("@every 1h30m", "2024-01-01T00:00:00", "2024-01-01T01:30:00"),
    ],
)
def test_schedules(schedule, start, want):
    assert parse(schedule).after(at(start)) == at(want)


@pytest.mark.parametrize("bad", ["", "* *", "0 0 0 32 * *", "0 0 0 * foo *", "@every x", "0 60 * * * *", "0 5-1 * * * *", "0 */0 * * * *"])
def test_bad_schedules(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_cron_matches_plain_search():
    for schedule in ("0 7 */6 * * *", "0 0 5 1-7 * sun", "0 59 23 28-31 2,12 *"):
        s, t = parse(schedule), at("2024-02-20T00:00:00")
        for _ in range(5):
            following = s.after(t)
            plain = t + timedelta(minutes=1)
            while not (plain.minute in s.fields[1] and plain.hour in s.fields[2] and plain.month in s.fields[4] and s._day(plain)):
                plain += timedelta(minutes=1)
            assert following == plain
            t = following


def test_scheduler_coalesces_or_makes_up(tmp_path):
    r = Registry(str(tmp_path / "jobs.db"))
    start = at("2024-01-01T00:00:00")
    once = r.create_task(start, name="once", schedule="0 * * * * *", command="x")["id"]
    each = r.create_task(start, name="each", schedule="0 * * * * *", command="x", coalesce=0)["id"]
    off = r.create_task(start, name="off", schedule="0 * * * * *", command="x", enabled=0)["id"]
    s = Scheduler(r, run=lambda task: (task["name"] == "once", f"line\nran {task['name']}"))
    assert s.next(start) == []
    runs = []
    for _ in range(5):
        runs += s.next(start + timedelta(minutes=3, seconds=30))
        s.wait()
    assert sorted(runs) == [once, each, each, each] and not r.invocations(off)
    assert [i["success"] for i in r.invocations(each)] == [0, 0, 0] and r.invocations(each)[0]["error_message"] == "ran each"
    assert r.invocations(once, 1)[0]["success"] == 1 and r.task(once)["next_run"] == at("2024-01-01T00:04:00").isoformat()
    with pytest.raises(ValueError):
        r.create_task(name="bad", schedule="x", command="y")
    with pytest.raises(KeyError):
        r.update_task(99, enabled=1)


def test_one_run_at_a_time_in_a_child_process(tmp_path):
    r = Registry(str(tmp_path / "jobs.db"))
    start = at("2024-01-01T00:00:00")
    k = r.create_task(start, name="t", schedule="@every 1s", command=sys.executable, args="-c 'import time; print(5); time.sleep(30)'")["id"]
    s = Scheduler(r, str(tmp_path))
    assert s.next(start + timedelta(seconds=5)) == [k] and s.next(start + timedelta(seconds=9)) == []
    while k not in s.children:
        pass
    s.stop_task(k)
    s.wait()
    assert r.invocations(k)[0]["success"] == 0
    r.update_task(k, start, args="-c 'print(7)'")
    assert s.next(start + timedelta(seconds=20)) == [k]
    s.wait()
    assert r.invocations(k, 1)[0]["log"] == "7\n"


def test_server(spark, tmp_path):
    from http.server import ThreadingHTTPServer

    origin = tmp_path / "origin"
    git = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    origin.mkdir()
    (origin / "s.txt").write_text("x")
    for a in (("init", "-q"), ("add", "."), ("commit", "-qm", "first")):
        git(*a)
    registry = Registry(str(tmp_path / "jobs.db"))
    (tmp_path / "work").mkdir()
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(Service(registry, Scheduler(registry, str(tmp_path / "work")), lambda: spark)))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        try:
            with urlopen(Request(f"http://127.0.0.1:{server.server_port}{path}", method=method, data=json.dumps(body).encode() if body is not None else None)) as a:
                return a.status, json.loads(a.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    task = ask("POST", "/tasks", {"name": "t", "schedule": "@daily", "command": "c"})[1]
    assert ask("GET", f"/tasks/{task['id']}")[1] == task and len(ask("GET", "/tasks")[1]) == 1
    assert ask("PUT", f"/tasks/{task['id']}", {"schedule": "@hourly"})[1]["schedule"] == "@hourly"
    assert ask("PUT", f"/tasks/{task['id']}/disable")[1]["enabled"] == 0 and ask("PUT", f"/tasks/{task['id']}/enable")[1]["enabled"] == 1
    assert ask("GET", f"/tasks/{task['id']}/last-invocation") == (200, None) and ask("GET", "/invocations") == (200, [])
    assert ask("POST", "/tasks", {"name": "t2"})[0] == 400 and ask("GET", "/tasks/77")[0] == 404 and ask("GET", "/nope")[0] == 404
    repo = ask("POST", "/repositories", {"name": "r", "remote_url": str(origin)})[1]
    assert repo["last_commit_message"] == "first" and ask("GET", f"/repositories/{repo['id']}/files")[1] == ["s.txt"]
    (origin / "t.txt").write_text("y")
    git("add", ".")
    git("commit", "-qm", "second")
    assert ask("POST", f"/repositories/{repo['id']}/update")[1]["last_commit_message"] == "second"
    assert ask("POST", "/repositories", {"name": "../x", "remote_url": str(origin)})[0] == 400
    assert ask("DELETE", f"/repositories/{repo['id']}")[0] == 200 and ask("GET", "/repositories")[1] == []
    script = "DATA 'D' ([[1]]) INTO CONSOLE WITH (COLUMNS = 'n', OUTPUT_FORMAT = 'JSON')"
    assert json.loads(ask("POST", "/run", {"script": script})[1]["output"]) == [{"n": 1}]
    assert ask("POST", "/compile", {"script": script})[1] == {"output": ""} and ask("POST", "/compile", {"script": "DATA"})[0] == 400
    assert ask("DELETE", f"/tasks/{task['id']}")[0] == 200
    server.shutdown()
