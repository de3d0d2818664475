"""Row assertions of TEST blocks, all of a block checked in one aggregation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWS = re.compile(r"it\s+outputs\s+(at\s+least|at\s+most|exactly)\s+(\d+)\s+rows?$", re.I)
_DISTINCT = re.compile(r"column\s+(\S+)\s+has\s+(at\s+least|at\s+most|exactly)\s+(\d+)\s+distinct\s+values?$", re.I)
_UNIQUE = re.compile(r"column\s+(\S+)\s+has\s+unique\s+values?$", re.I)
_NO_NULL = re.compile(r"column\s+(\S+)\s+has\s+no\s+null\s+values?$", re.I)
_SATISFIES = re.compile(r"it\s+satisfies\s+(.+)$", re.I | re.S)


@dataclass
class Assertion:
    text: str
    kind: str
    column: str | None = None
    relation: str | None = None
    number: int = 0


def parse(body: str) -> list[Assertion]:
    out = []
    for text in (t.strip() for t in re.sub(r"--[^\n]*", "", body).split(";")):
        if not text:
            continue
        if m := _ROWS.match(text):
            out.append(Assertion(text, "rows", None, re.sub(r"\s+", " ", m[1].lower()), int(m[2])))
        elif m := _DISTINCT.match(text):
            out.append(Assertion(text, "distinct", m[1], re.sub(r"\s+", " ", m[2].lower()), int(m[3])))
        elif m := _UNIQUE.match(text):
            out.append(Assertion(text, "unique", m[1]))
        elif m := _NO_NULL.match(text):
            out.append(Assertion(text, "no null", m[1]))
        elif m := _SATISFIES.match(text):
            out.append(Assertion(text, "satisfies", m[1].replace("==", "=")))
        else:
            raise SyntaxError(f"not an assertion: {text}")
    return out


def _holds(relation: str, n: Column, number: int) -> Column:
    return {"at least": n >= number, "at most": n <= number, "exactly": n == number}[relation]


def results(df: DataFrame, body: str) -> DataFrame:
    """assertion, passed of each. Null counts as a value; a column that is not there is an error."""
    checks = parse(body)
    columns = {c.lower(): c for c in df.columns}

    def column(name: str) -> Column:
        if name.lower() not in columns:
            raise ValueError(f"unknown column '{name}'; there are {', '.join(df.columns)}")
        return F.col(f"`{columns[name.lower()]}`")

    def passed(a: Assertion) -> Column:
        rows = F.count(F.lit(1))
        if a.kind == "rows":
            return _holds(a.relation, rows, a.number)
        if a.kind == "no null":
            return F.count_if(column(a.column).isNull()) == 0
        if a.kind == "satisfies":
            return F.count_if(~F.coalesce(F.expr(a.column).cast("boolean"), F.lit(False))) == 0
        c = column(a.column)
        kinds = F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1)), F.lit(0))
        return kinds == rows if a.kind == "unique" else _holds(a.relation, kinds, a.number)

    one = df.agg(*[passed(a).alias(f"a{i}") for i, a in enumerate(checks)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a.text).alias("assertion"), F.col(f"a{i}").alias("passed")) for i, a in enumerate(checks)])).alias("x")).select("x.*")


class AssertionFailed(AssertionError):
    pass


def check(df: DataFrame, block: str, body: str) -> None:
    failed = [r["assertion"] for r in results(df, body).collect() if not r["passed"]]
    if failed:
        raise AssertionFailed(f"{block}: {'; '.join(failed)}")
