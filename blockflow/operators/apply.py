"""APPLY: projection, renaming and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import CASTS
from .text import Tokens


def parse(body: str) -> list[tuple[str, str | None, str]]:
    """(column, cast or None, output name) of each item."""
    t = Tokens(body)
    if not t.word("apply"):
        raise SyntaxError("APPLY expected")
    out = []
    while True:
        kind = None
        if t.peek()[1].lower() == "cast" and t.peek(1) == ("mark", "("):
            t.at += 2
            column = t.need("name")
            if not t.word("as"):
                raise SyntaxError("AS expected in CAST")
            kind = t.need("name").lower()
            if kind not in CASTS:
                raise SyntaxError(f"unknown destination type {kind}")
            t.need("mark", ")")
        else:
            column = t.need("name")
        out.append((column, kind, t.next()[1] if t.word("as") else column))
        if not t.mark(","):
            break
    t.end()
    return out


def apply(df: DataFrame, body: str) -> DataFrame:
    fields = {f.name.lower(): f for f in df.schema}
    columns = []
    for name, kind, alias in parse(body):
        if name.lower() not in fields:
            raise ValueError(f"unknown column '{name}'; there are {', '.join(df.columns)}")
        f = fields[name.lower()]
        c = F.col(f"`{f.name}`")
        columns.append((CASTS[kind](c, f.dataType) if kind else c).alias(alias))
    return df.select(*columns)
