"""Templates in bodies and paths.

{{ .Key }} shows a value and {{ . }} the whole context; {{ if }}, {{ else if }},
{{ with }}, {{ range }}, {{ else }} and {{ end }} nest; a | b hands a's value to b
as its last argument; $name := value keeps one; {{- and -}} trim white space
beside them; {{/* */}} is a comment. Functions are listed in FUNCTIONS."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote_plus

from .model import Value

_TAG = re.compile(r"(\{\{.*?\}\})", re.S)
_WORD = re.compile(r'"(?:[^"\\]|\\.)*"|`[^`]*`|:=|[|()=,]|[^\s|()=,"`:]+|:')
_NUMBER = re.compile(r"[+-]?\d+(\.\d+)?$")


@dataclass
class Node:
    """Text, or an action with what it holds. kind: text, show, if, with, range."""

    kind: str
    words: list[str] = field(default_factory=list)
    text: str = ""
    body: list[Node] = field(default_factory=list)
    other: list[Node] = field(default_factory=list)


def _shown(v: object) -> str:
    if v is None:
        return "<no value>"
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _order(test: Callable[[object, object], bool]) -> Callable[[object, object], bool]:
    """Numbers compare as numbers, everything else as the text that it shows."""

    def compare(a: object, b: object) -> bool:
        numbers = [x for x in (a, b) if isinstance(x, (int, float)) or (isinstance(x, str) and _NUMBER.match(x))]
        return test(float(a), float(b)) if len(numbers) == 2 else test(_shown(a), _shown(b))

    return compare


def _index(v: object, *keys: object) -> object:
    for k in keys:
        v = v[int(k)] if isinstance(v, (list, tuple, str)) else (v or {}).get(k)
    return v


def _format(pattern: str, *args: object) -> str:
    kinds = {"d": lambda v: int(float(v)), "s": _shown, "v": _shown, "q": lambda v: json.dumps(_shown(v), ensure_ascii=False), "f": float, "g": float, "e": float, "x": int, "t": _shown}
    rest = iter(args)

    def one(m: re.Match) -> str:
        if m[2] == "%":
            return "%"
        kind = m[2] if m[2] in "dfgex" else "s"
        return f"%{m[1]}{kind}" % kinds[m[2]](next(rest))

    return re.sub(r"%([-+0 ]*\d*(?:\.\d+)?)([dsvqfgext%])", one, pattern)


_eq = _order(lambda a, b: a == b)
FUNCTIONS: dict[str, Callable] = {
    "eq": lambda a, *b: any(_eq(a, x) for x in b),
    "ne": lambda a, b: not _eq(a, b),
    "lt": _order(lambda a, b: a < b),
    "le": _order(lambda a, b: a <= b),
    "gt": _order(lambda a, b: a > b),
    "ge": _order(lambda a, b: a >= b),
    "not": lambda a: not a,
    "and": lambda *a: next((x for x in a if not x), a[-1]),
    "or": lambda *a: next((x for x in a if x), a[-1]),
    "len": lambda a: len(a or ()),
    "index": _index,
    "print": lambda *a: "".join(map(_shown, a)),
    "println": lambda *a: " ".join(map(_shown, a)) + "\n",
    "printf": _format,
    "urlquery": lambda *a: quote_plus("".join(map(_shown, a))),
    "js": lambda a: json.dumps(_shown(a))[1:-1].replace("'", "\\'"),
    "html": lambda a: reduce(lambda t, p: t.replace(*p), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")), _shown(a)),
}


def parse(text: str) -> list[Node]:
    root = Node("root")
    open_nodes: list[tuple[Node, list[Node], int]] = []  # node, where to go on, how many ends close with it
    into = root.body
    parts = _TAG.split(text)
    for i, part in enumerate(parts):
        if not part.startswith("{{") or not part.endswith("}}"):
            before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
            part = part.lstrip() if before.endswith("-}}") else part
            part = part.rstrip() if after.startswith("{{-") else part
            into.append(Node("text", text=part))
            continue
        inner = part[2:-2].removeprefix("-").removesuffix("-").strip()
        if inner.startswith("/*"):
            continue
        words = _WORD.findall(inner)
        head = words[0] if words else ""
        if head in ("if", "with", "range"):
            node = Node(head, words[1:])
            into.append(node)
            open_nodes.append((node, into, 1))
            into = node.body
        elif head == "else":
            if not open_nodes:
                raise ValueError("{{ else }} without {{ if }}")
            node, back, ends = open_nodes.pop()
            if len(words) > 1:
                chained = Node(words[1], words[2:])
                node.other.append(chained)
                open_nodes += [(node, back, ends), (chained, node.other, 0)]
                into = chained.body
            else:
                open_nodes.append((node, back, ends))
                into = node.other
        elif head == "end":
            if not open_nodes:
                raise ValueError("{{ end }} without {{ if }}")
            while True:
                node, into, ends = open_nodes.pop()
                if ends:
                    break
        elif not head:
            raise ValueError("an empty action")
        else:
            into.append(Node("show", words))
    if open_nodes:
        raise ValueError(f"{{{{ {open_nodes[0][0].kind} }}}} without {{{{ end }}}}")
    return root.body


def render(text: str, values: dict[str, Value]) -> str:
    """Keys in their own case; a key that is not there gives '<no value>' and counts as false."""
    return _render(parse(text), values, {"$": values}) if "{{" in text else text


def _get(context: object, name: str) -> object:
    if not isinstance(context, dict):
        raise ValueError(f"no key {name!r} in {_shown(context)!r}")
    return context.get(name, context.get(name.upper()))


def _value(word: str, context: object, names: dict[str, object]) -> object:
    if word[0] in '"`':
        return json.loads(word) if word[0] == '"' else word[1:-1]
    if _NUMBER.match(word):
        return float(word) if "." in word else int(word)
    if word in ("true", "false", "nil"):
        return {"true": True, "false": False, "nil": None}[word]
    if word.startswith(("$", ".")):
        first, *keys = word.split(".") if word.startswith("$") else ["", *word.split(".")[1:]]
        if first and first not in names:
            raise ValueError(f"unknown variable {first}")
        return reduce(_get, [k for k in keys if k], names[first] if first else context)
    if word in FUNCTIONS:
        return FUNCTIONS[word]
    raise ValueError(f"unsupported template action {word!r}")


def _pipeline(words: list[str], context: object, names: dict[str, object]) -> object:
    """The value of words with | between calls; parentheses nest."""
    given: list[object] = []
    terms: list[object] = []
    at = 0
    for i in [*(i for i, w in enumerate(words) if w == "|" and words[:i].count("(") == words[:i].count(")")), len(words)]:
        terms, k = [], at
        while k < i:
            if words[k] == "(":
                depth, end = 1, k + 1
                while depth:
                    if end >= i:
                        raise ValueError("a parenthesis is not closed")
                    depth += (words[end] == "(") - (words[end] == ")")
                    end += 1
                terms.append(_pipeline(words[k + 1 : end - 1], context, names))
                k = end
            else:
                terms.append(_value(words[k], context, names))
                k += 1
        if not terms:
            raise ValueError("an empty action")
        args = [*terms[1:], *given]
        if callable(terms[0]):
            given = [terms[0](*args)]
        elif args:
            raise ValueError(f"{words[at]!r} takes no arguments")
        else:
            given = [terms[0]]
        at = i + 1
    return given[0]


def _render(nodes: list[Node], context: object, names: dict[str, object]) -> str:
    out = ""
    names = dict(names)
    for n in nodes:
        if n.kind == "text":
            out += n.text
            continue
        kept: list[str] = []
        words = n.words
        if any(op in words for op in (":=", "=")):
            op = next(i for i, w in enumerate(words) if w in (":=", "="))
            kept, words = [w for w in words[:op] if w != ","], words[op + 1 :]
        value = _pipeline(words, context, names)
        inner = dict(names)
        if kept and n.kind != "range":
            inner[kept[0]] = value
        if n.kind == "show":
            if kept:
                names[kept[0]] = value
            else:
                out += _shown(value)
        elif n.kind == "range":
            items = list(value.items()) if isinstance(value, dict) else list(enumerate(value or ()))
            for key, item in items:
                own = dict(zip(kept, (key, item) if len(kept) > 1 else (item,), strict=True)) if kept else {}
                out += _render(n.body, item, inner | own)
            if not items:
                out += _render(n.other, context, names)
        elif value:
            out += _render(n.body, value if n.kind == "with" else context, inner)
        else:
            out += _render(n.other, context, inner)
    return out
