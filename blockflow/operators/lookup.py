"""LOOKUP: each base row meets at most one row of the lookup table, the last with its key; null equals null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Tokens


@dataclass
class Lookup:
    items: list[tuple[str, str, str]]
    base: str
    other: str
    outer: bool
    keys: list[tuple[str, str]]


def parse(body: str) -> Lookup:
    t = Tokens(body)

    def dotted() -> tuple[str, str]:
        source = t.need("name")
        t.need("mark", ".")
        return source.lower(), t.need("name")

    if not t.word("lookup"):
        raise SyntaxError("LOOKUP expected")
    items = []
    while True:
        source, column = dotted()
        items.append((source, column, t.next()[1] if t.word("as") else column))
        if not t.mark(","):
            break
    if not t.word("from"):
        raise SyntaxError("FROM expected")
    base = t.need("name").lower()
    outer = t.word("outer")
    if not outer and not t.word("inner"):
        raise SyntaxError("INNER or OUTER expected")
    if not t.word("join"):
        raise SyntaxError("JOIN expected")
    other = t.need("name").lower()
    if not t.word("on"):
        raise SyntaxError("ON expected")
    keys = []
    while True:
        a = dotted()
        t.need("mark", "=")
        b = dotted()
        if {a[0], b[0]} != {base, other} or base == other:
            raise SyntaxError(f"a condition must compare {base} with {other}")
        keys.append((a[1], b[1]) if a[0] == base else (b[1], a[1]))
        if not t.word("and"):
            break
    t.end()
    for source, column, _ in items:
        if source not in (base, other):
            raise SyntaxError(f"unknown source {source} of {column}")
    return Lookup(items, base, other, outer, keys)


def lookup(sources: dict[str, DataFrame], body: str) -> DataFrame:
    """Later rows win over earlier ones of equal key, in the order the lookup table arrives.

    The side to broadcast is left to the planner, which knows the sizes at run time."""
    spec = parse(body)
    by_name = {k.lower(): v for k, v in sources.items()}
    for name in (spec.base, spec.other):
        if name not in by_name:
            raise ValueError(f"unknown source {name}; there are {', '.join(by_name)}")
    base, other = by_name[spec.base], by_name[spec.other]

    def actual(df: DataFrame, name: str) -> str:
        found = [c for c in df.columns if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"unknown column '{name}'; there are {', '.join(df.columns)}")
        return found[0]

    keys = [(actual(base, a), actual(other, b)) for a, b in spec.keys]
    wanted = list(dict.fromkeys(actual(other, c) for s, c, _ in spec.items if s == spec.other))
    right_keys = [F.col(f"`{b}`").alias(f"__key_{i}") for i, (_, b) in enumerate(keys)]
    last = (
        other.select(*right_keys, F.struct(F.lit(True).alias("__hit"), *[F.col(f"`{c}`") for c in wanted]).alias("__row"), F.monotonically_increasing_id().alias("__order"))
        .groupBy(*[f"__key_{i}" for i in range(len(keys))])
        .agg(F.max_by("__row", "__order").alias("__row"))
    )
    types_left, types_right = dict(base.dtypes), dict(other.dtypes)
    on = None
    for i, (a, b) in enumerate(keys):
        left, right = base[f"`{a}`"], last[f"__key_{i}"]
        if types_left[a] != types_right[b] and "string" in (types_left[a], types_right[b]):
            left, right = left.cast("string"), right.cast("string")
        one = left.eqNullSafe(right)
        on = one if on is None else on & one
    joined = base.join(last, on, "left" if spec.outer else "inner")
    return joined.select(*[(F.col("__row").getField(actual(other, c)) if s == spec.other else base[f"`{actual(base, c)}`"]).alias(a) for s, c, a in spec.items])
