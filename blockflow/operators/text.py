"""Tokens of transform bodies."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*')|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_@][\w@]*|\[[^\]]+\]|`[^`]+`)|(?P<mark>[(),.=*]))")


class Tokens:
    def __init__(self, body: str):
        body = re.sub(r"--[^\n]*", "", body).strip().rstrip(";").strip()
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                raise SyntaxError(f"unexpected {body[at : at + 20]!r}")
            kind = m.lastgroup or ""
            value = m[kind]
            self.items.append((kind, value.strip("'") if kind == "text" else value.strip("[]`") if kind == "name" else value))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        item = self.peek()
        self.at += 1
        return item

    def word(self, *words: str) -> bool:
        """Takes the given words if they come next, in any case."""
        if all(self.peek(i)[0] == "name" and self.peek(i)[1].lower() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def mark(self, mark: str) -> bool:
        if self.peek() == ("mark", mark):
            self.at += 1
            return True
        return False

    def need(self, kind: str, value: str | None = None) -> str:
        got = self.next()
        if got[0] != kind or value is not None and got[1] != value:
            raise SyntaxError(f"expected {value or kind}, got {got[1]!r}")
        return got[1]

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise SyntaxError(f"unexpected {self.peek()[1]!r}")
