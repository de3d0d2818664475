"""Forwards log records to a chat's incoming web hook, several at a time."""

from __future__ import annotations

import json
import logging
import threading
from collections.abc import Callable
from urllib.request import Request, urlopen

Post = Callable[[str, bytes], None]


def post(url: str, body: bytes) -> None:
    with urlopen(Request(url, data=body, headers={"Content-Type": "application/json"}), timeout=30):  # noqa: S310
        pass


class ChatHandler(logging.Handler):
    """Holds records back until `lines` are there, one is an error, or flush() is called; what a hook refuses is given up, never raised into the job."""

    COLOURS = {logging.WARNING: "warning", logging.ERROR: "danger", logging.CRITICAL: "danger"}

    def __init__(self, url: str, name: str = "blockflow", channel: str | None = None, lines: int = 20, level: int = logging.INFO, send: Post = post):
        super().__init__(level)
        self.url, self.name, self.channel, self.lines, self.send = url, name, channel, lines, send
        self.held: list[dict[str, str]] = []
        self.guard = threading.Lock()

    def emit(self, record: logging.LogRecord) -> None:
        entry = {"color": self.COLOURS.get(record.levelno, "good"), "title": record.levelname, "text": self.format(record), "footer": record.name}
        with self.guard:
            self.held.append(entry)
            full = len(self.held) >= self.lines or record.levelno >= logging.ERROR
        if full:
            self.flush()

    def flush(self) -> None:
        with self.guard:
            ready, self.held = self.held, []
        if not ready:
            return
        message = {"username": self.name, "attachments": ready} | ({"channel": self.channel} if self.channel else {})
        try:
            self.send(self.url, json.dumps(message).encode())
        except Exception:
            self.handleError(logging.makeLogRecord({"msg": "a chat hook refused a message", "levelno": logging.WARNING}))

    def close(self) -> None:
        self.flush()
        super().close()
