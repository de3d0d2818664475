"""AGGREGATE: grouped reducers. Every reducer gives a nullable double."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import instant, parse_time
from .series import with_next
from .text import Tokens


@dataclass
class Argument:
    kind: str
    value: str

    def literal(self):
        return float(self.value) if self.kind == "number" else self.value


@dataclass
class Term:
    name: str
    function: str | None = None
    args: list[Argument] = field(default_factory=list)
    alias: str | None = None


@dataclass
class Aggregate:
    terms: list[Term]
    keys: list[str]


class Frame:
    """The input of an aggregation: resolves columns in any case and takes helper columns."""

    def __init__(self, df: DataFrame, keys: list[str]):
        self.df, self.keys, self.helpers = df, keys, 0

    def field(self, name: str) -> T.StructField:
        found = [f for f in self.df.schema if f.name.lower() == name.lower()]
        if not found:
            raise ValueError(f"unknown column '{name}'; there are {', '.join(self.df.columns)}")
        return found[0]

    def column(self, a: Argument) -> tuple[Column, T.DataType]:
        if a.kind == "number":
            return F.lit(float(a.value)), T.DoubleType()
        if a.kind == "text":
            return F.lit(a.value), T.StringType()
        f = self.field(a.value)
        return F.col(f"`{f.name}`"), f.dataType

    def number(self, a: Argument) -> Column:
        c, kind = self.column(a)
        if not isinstance(kind, (T.NumericType, T.BooleanType, T.NullType)):
            raise TypeError(f"{a.value} must be a number, not {kind.simpleString()}")
        return c.cast("double")

    def add(self, c: Column) -> Column:
        self.helpers += 1
        name = f"__helper_{self.helpers}"
        self.df = self.df.withColumn(name, c)
        return F.col(name)


def _ordered(reduce: Callable[[Column], Column]) -> Callable[[Frame, list[Argument]], Column]:
    """MIN and MAX: numbers as they are, texts as times in Unix seconds."""

    def build(frame: Frame, args: list[Argument]) -> Column:
        c, kind = frame.column(args[0])
        if isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.unix_seconds(reduce(instant(c, kind))).cast("double")
        return reduce(frame.number(args[0]))

    return build


def _count(frame: Frame, args: list[Argument]) -> Column:
    return F.count(frame.column(args[0])[0]).cast("double")


def _share(a: Argument) -> float:
    if a.kind != "number":
        raise ValueError("the second argument must be a number")
    return float(a.value)


def _quantile(frame: Frame, args: list[Argument]) -> Column:
    q = _share(args[1])
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    return F.percentile(frame.number(args[0]), q).cast("double")  # exact: keeps a group's distinct values


def _approx_quantile(frame: Frame, args: list[Argument]) -> Column:
    """Quantile by a sketch of bounded size: the value whose rank is off by a ten-thousandth of the rows at most, one of those present."""
    q = _share(args[1])
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    return F.percentile_approx(frame.number(args[0]), q, 10_000).cast("double")


def _cdf(frame: Frame, args: list[Argument]) -> Column:
    x = frame.number(args[0])
    return F.avg(F.when(x <= _share(args[1]), 1.0).when(x.isNotNull(), 0.0))


def _zoh(frame: Frame, args: list[Argument]) -> Column:
    """Time-weighted mean over [start, finish] of the step function that holds each value until the next time.

    Points without time or value are passed over. Null if the window is empty or
    begins before the first point. The next time comes from windows over slices of
    the groups' series, so that no task holds a series."""
    c, kind = frame.column(args[0])
    seconds = lambda t: F.unix_micros(t) / F.lit(1e6)
    v = frame.number(args[1])
    t = frame.add(F.when(v.isNotNull(), seconds(instant(c, kind))))
    time = f"__helper_{frame.helpers}"
    start, finish = (seconds(parse_time(F.lit(a.value)) if a.kind == "text" else instant(*frame.column(a))) for a in args[2:])
    frame.helpers += 1
    name = f"__helper_{frame.helpers}"
    frame.df = with_next(frame.df, [frame.field(k).name for k in frame.keys], time, name)
    later = F.col(name)
    hold = F.greatest(F.lit(0.0), F.least(F.coalesce(later, finish), finish) - F.greatest(t, start))
    part = frame.add(F.when(t.isNotNull(), v * hold))
    begin, end = frame.add(start), frame.add(finish)
    whole = F.max(end) - F.max(begin)
    return F.when((whole > 0) & (F.min(t) <= F.max(begin)), F.sum(part) / whole)


#: Name -> number of arguments and builder.
REDUCERS: dict[str, tuple[int, Callable[[Frame, list[Argument]], Column]]] = {
    "sum": (1, lambda f, a: F.sum(f.number(a[0]))),
    "avg": (1, lambda f, a: F.avg(f.number(a[0]))),
    "min": (1, _ordered(F.min)),
    "max": (1, _ordered(F.max)),
    "count": (1, _count),
    "quantile": (2, _quantile),
    "approx_quantile": (2, _approx_quantile),
    "cdf": (2, _cdf),
    "zoh": (4, _zoh),
}


def parse(body: str) -> Aggregate:
    t = Tokens(body)
    if not t.word("aggregate"):
        raise SyntaxError("AGGREGATE expected")
    terms = []
    while True:
        name = t.need("name")
        term = Term(name)
        if t.mark("("):
            term.function = name.lower()
            if term.function not in REDUCERS:
                raise SyntaxError(f"unknown function {name}")
            while not t.mark(")"):
                kind, value = t.next()
                if kind not in ("name", "text", "number"):
                    raise SyntaxError(f"bad argument {value!r} of {name}")
                term.args.append(Argument(kind, value))
                t.mark(",")
            if len(term.args) != REDUCERS[term.function][0]:
                raise SyntaxError(f"{name} takes {REDUCERS[term.function][0]} arguments, got {len(term.args)}")
        if t.word("as"):
            term.alias = t.next()[1]
        if term.function and not term.alias:
            raise SyntaxError(f"{name}(...) needs an alias")
        terms.append(term)
        if not t.mark(","):
            break
    if t.word("from"):
        t.next()
    keys = []
    if t.word("group", "by"):
        keys.append(t.need("name"))
        while t.mark(","):
            keys.append(t.need("name"))
    t.end()
    aliases = {x.alias.lower(): x.name for x in terms if x.alias and not x.function}
    keys = [aliases.get(k.lower(), k) for k in keys]
    for x in terms:
        if not x.function and x.name.lower() not in {k.lower() for k in keys}:
            raise SyntaxError(f"column {x.name} is neither reduced nor in GROUP BY")
    return Aggregate(terms, keys)


def aggregate(df: DataFrame, body: str) -> DataFrame:
    """One row a group, in the order of the terms; without GROUP BY one row, or none from no input."""
    spec = parse(body)
    frame = Frame(df, spec.keys)
    keys = [frame.field(k).name for k in spec.keys]
    built = [(x, REDUCERS[x.function][1](frame, x.args)) for x in spec.terms if x.function]
    rows = F.count(F.lit(1)).alias("__rows")
    grouped = frame.df.groupBy(*[F.col(f"`{k}`") for k in keys])
    if not built:
        out = frame.df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    else:
        out = grouped.agg(*[c.alias(f"__agg_{i}") for i, (_, c) in enumerate(built)], rows)
        if not keys:
            out = out.where("__rows > 0")
    at = {id(x): f"__agg_{i}" for i, (x, _) in enumerate(built)}
    return out.select(*[F.col(at[id(x)]).alias(x.alias) if x.function else F.col(f"`{frame.field(x.name).name}`").alias(x.alias or x.name) for x in spec.terms])
