"""Console, parameters and e-mail: outputs of bounded size, made on the driver row by row."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from datetime import datetime
from typing import TextIO

from pyspark.sql import DataFrame

_MAILBOX = re.compile(r"^\s*(?:(?P<name>[^<>@,;:]+?)\s*<\s*(?P<a>[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,3})\s*>|(?P<b>[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,3}))\s*$")


def plain(v):
    """A cell for JSON: whole doubles without a fraction, times as RFC 3339."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return int(v)
    return v.strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(v, datetime) else v


def console(df: DataFrame, form: str = "TABLE", out: TextIO | None = None) -> None:
    """TABLE: aligned columns; JSON: an array of objects. Rows stream from one partition at a time."""
    out = out or sys.stderr
    if form.upper() == "JSON":
        out.write("[")
        for i, r in enumerate(df.toLocalIterator()):
            out.write((", " if i else "") + json.dumps({k: plain(v) for k, v in sorted(r.asDict().items())}, ensure_ascii=False))
        out.write("]\n")
    elif form.upper() == "TABLE":
        rows = [[str(plain(v)) for v in r] for r in df.toLocalIterator()]
        wide = [max(map(len, c)) for c in zip(df.columns, *rows, strict=True)]
        for r in [df.columns, ["-" * w for w in wide], *rows]:
            out.write(" | ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() + "\n")
    else:
        raise ValueError(f"unknown output format {form}")


def recipients(text: str) -> list[tuple[str, str]]:
    """(name, address) of each of a comma-separated list."""
    out = []
    for part in text.split(","):
        m = _MAILBOX.match(part)
        if not m:
            raise ValueError(f"bad recipient {part.strip()!r}")
        out.append(((m["name"] or "").strip(), m["a"] or m["b"]))
    return out


def mails(df: DataFrame, to: str, sender: str, subject: str, template: str, split: bool = False) -> list[dict]:
    """The messages to send: one a row if split, else one with all rows."""
    sends = recipients(sender)[0] if sender else ("", "")
    rows = [{k: plain(v) for k, v in r.asDict().items()} for r in df.toLocalIterator()]
    groups = [[r] for r in rows] if split else [rows]
    return [{"template": template, "to": [{"name": n, "email": a} for n, a in recipients(to)], "from": {"name": sends[0], "email": sends[1]}, "subject": subject, "rows": g} for g in groups]


Mailer = Callable[[str, dict], None]
