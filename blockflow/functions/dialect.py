"""Rewrites of SQL written for small embedded databases into Spark SQL; quotes and comments are respected."""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal

_PIECE = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_@][\w@]*|\s+|.", re.S)


def pieces(sql: str) -> list[str]:
    return _PIECE.findall(sql)


def statements(sql: str) -> list[str]:
    """Statements between semicolons, comments dropped, blanks left out."""
    out, now = [], []
    for p in pieces(sql):
        if p == ";":
            out.append("".join(now))
            now = []
        elif not p.startswith(("--", "/*")):
            now.append(p)
    return [s.strip() for s in [*out, "".join(now)] if s.strip()]


def marks(sql: str) -> int:
    """Parameter marks (?) outside of quotes and comments."""
    return pieces(sql).count("?")


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, (datetime, date)):
        return f"{'TIMESTAMP' if isinstance(value, datetime) else 'DATE'} '{value}'"
    return "'" + str(value).replace("'", "''") + "'"


def bound(sql: str, args: list) -> str:
    """sql with its marks replaced by the arguments as literals, in order; what stands in quotes or comments is left alone."""
    parts = pieces(sql)
    if parts.count("?") != len(args):
        raise ValueError(f"{len(args)} arguments for {parts.count('?')} marks")
    rest = iter(args)
    return "".join(_literal(next(rest)) if p == "?" else p for p in parts)


def rewrite(sql: str) -> str:
    """Text aliases and double-quoted names become backquoted ones, LIKE ignores case, TOP n becomes LIMIT n."""
    out: list[str] = []
    top = None
    words: list[str] = []
    for p in pieces(sql):
        if p.startswith(("--", "/*")):
            continue
        if p.startswith('"'):
            p = f"`{p[1:-1]}`"
        elif p.startswith("'") and words and words[-1] == "as":
            p = f"`{p[1:-1]}`"
        elif p.lower() == "like":
            p = "ILIKE"
        out.append(p)
        if not p.isspace():
            words.append(p.lower())
    text = "".join(out)
    if m := re.match(r"\s*select\s+top\s+(\d+)\s", text, re.I):
        top = m[1]
        text = re.sub(r"^(\s*select)\s+top\s+\d+\s", r"\1 ", text, count=1, flags=re.I)
    return f"{text.rstrip()} LIMIT {top}" if top else text


#: Declared column types and what they become.
TYPES = {
    "text": "string", "varchar": "string", "nvarchar": "string", "char": "string", "string": "string", "clob": "string",
    "int": "bigint", "integer": "bigint", "bigint": "bigint", "smallint": "bigint", "tinyint": "bigint",
    "real": "double", "number": "double", "numeric": "double", "decimal": "double", "float": "double", "double": "double",
    "bool": "boolean", "boolean": "boolean", "datetime": "timestamp", "timestamp": "timestamp", "date": "date", "blob": "binary",
}
