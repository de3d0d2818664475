"""Reads scripts. Bodies in parentheses stay raw; quotes and comments inside them hide parentheses."""

from __future__ import annotations

import re

from .model import Block, End, Script, Value

_TOKEN = re.compile(r"(?P<blank>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'[^']*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_@][\w@.]*)|(?P<mark>[(),;=])", re.S)


class ScriptError(ValueError):
    pass


class Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _scan(self, at: int) -> tuple[str, str, int]:
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                raise ScriptError(f"line {self.line(at)}: unexpected {self.text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup != "blank":
                return m.lastgroup or "", m[0], at
        return "end", "", at

    def line(self, at: int | None = None) -> int:
        return self.text.count("\n", 0, self.at if at is None else at) + 1

    def peek(self) -> tuple[str, str]:
        return self._scan(self.at)[:2]

    def next(self) -> tuple[str, str]:
        kind, value, self.at = self._scan(self.at)
        return kind, value

    def word(self, *words: str) -> bool:
        at = self.at
        for w in words:
            kind, value, at = self._scan(at)
            if kind != "name" or value.lower() != w:
                return False
        self.at = at
        return True

    def mark(self, mark: str) -> bool:
        kind, value, at = self._scan(self.at)
        if (kind, value) == ("mark", mark):
            self.at = at
            return True
        return False

    def need(self, *kinds: str) -> str:
        kind, value = self.next()
        if kind not in kinds:
            raise ScriptError(f"line {self.line()}: expected {' or '.join(kinds)}, got {value!r}")
        return value[1:-1] if kind == "text" else value

    def body(self) -> str:
        """What stands between this parenthesis and its partner."""
        if not self.mark("("):
            raise ScriptError(f"line {self.line()}: '(' expected")
        start, depth = self.at, 1
        for m in re.finditer(r"'(?:[^'])*'|--[^\n]*|/\*.*?\*/|[()]", self.text[start:], re.S):
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if not depth:
                self.at = start + m.end()
                return self.text[start : start + m.start()]
        raise ScriptError(f"line {self.line(start)}: '(' is never closed")

    def value(self) -> Value:
        kind, value = self.next()
        if kind == "text":
            return value[1:-1]
        if kind == "number":
            return float(value)
        raise ScriptError(f"line {self.line()}: a text or number expected, got {value!r}")

    def options(self) -> dict[str, Value]:
        if not self.mark("("):
            raise ScriptError(f"line {self.line()}: '(' expected after WITH")
        out: dict[str, Value] = {}
        while not self.mark(")"):
            key = self.need("name")
            if not self.mark("="):
                raise ScriptError(f"line {self.line()}: '=' expected after {key}")
            out[key.upper()] = self.value()
            if not self.mark(",") and self.peek() != ("mark", ")"):
                raise ScriptError(f"line {self.line()}: ',' or ')' expected in options")
        return out

    def end(self) -> End:
        if self.word("connection"):
            e = End("connection", self.need("name", "text"))
        elif self.word("global"):
            e = End("global")
        elif self.word("console"):
            e = End("console")
        elif self.word("block"):
            e = End("block", self.need("name", "text"))
        elif self.word("parameter"):
            if not self.mark("("):
                raise ScriptError(f"line {self.line()}: '(' expected after PARAMETER")
            names = [self.need("name")]
            while self.mark(","):
                names.append(self.need("name"))
            if not self.mark(")"):
                raise ScriptError(f"line {self.line()}: ')' expected")
            e = End("parameter", variables=[n.lower() for n in names])
        else:
            raise ScriptError(f"line {self.line()}: CONNECTION, GLOBAL, CONSOLE, PARAMETER or BLOCK expected, got {self.peek()[1]!r}")
        if self.word("as"):
            e.alias = self.need("text")
        return e

    def many(self, one) -> list:
        out = [one()]
        while self.mark(","):
            out.append(one())
        return out


def parse_options(text: str) -> dict[str, Value]:
    return Reader(f"({text})").options()


def parse(text: str) -> Script:
    r, s = Reader(text), Script()
    while r.peek()[0] != "end":
        if r.mark(";"):
            continue
        if r.word("description"):
            if s.description is None:
                s.description = r.need("text")
        elif r.word("include"):
            s.includes.append(r.need("text"))
        elif r.word("declare"):
            name = r.need("name", "text").lower()
            if name in s.declared:
                raise ScriptError(f"{name} is declared twice")
            s.declared.append(name)
        elif r.word("set"):
            key = r.need("name").upper()
            if not r.mark("="):
                raise ScriptError(f"line {r.line()}: '=' expected after SET {key}")
            s.settings[key] = r.value()
        elif r.word("connection"):
            b = Block("connection", r.need("text"))
            b.options = parse_options(r.body())
            if r.word("with"):
                b.options |= r.options()
            s.blocks.append(b)
        elif r.word("global"):
            b = Block("global", r.need("text"), r.body())
            if r.word("with"):
                b.options = r.options()
            s.blocks.append(b)
        elif r.word("test"):
            b = Block("test", r.need("name", "text"))
            if not r.word("with", "assertions"):
                raise ScriptError(f"line {r.line()}: WITH ASSERTIONS expected")
            _content(r, b)
            if r.word("with"):
                b.options = r.options()
            s.blocks.append(b)
        elif r.word("data"):
            b = Block("data", r.need("text"))
            _content(r, b)
            _tail(r, b)
            s.blocks.append(b)
        else:
            kind = next((k for k in ("query", "exec", "transform") if r.word(k)), None)
            if kind is None:
                raise ScriptError(f"line {r.line()}: unexpected {r.peek()[1]!r}")
            plugin = kind == "transform" and r.word("plugin")
            b = Block(kind, r.need("text"), plugin=plugin)
            if r.word("extern"):
                b.extern = r.need("text")
            if not r.word("from"):
                raise ScriptError(f"line {r.line()}: FROM expected in {b.name}")
            b.sources = r.many(r.end)
            if r.peek() == ("mark", "("):
                b.body = r.body()
            if kind != "transform" and r.word("using", "parameter"):
                b.parameters = [p.lower() for p in r.many(lambda: r.need("name"))]
            _tail(r, b)
            s.blocks.append(b)
    return s


def _content(r: Reader, b: Block) -> None:
    if r.word("extern"):
        b.extern = r.need("text")
    if r.peek() == ("mark", "("):
        b.body = r.body()


def _tail(r: Reader, b: Block) -> None:
    if r.word("into"):
        b.sinks = r.many(r.end)
    if r.word("with"):
        b.options = r.options()
    if r.word("after"):
        b.after = r.many(lambda: r.need("name", "text"))
