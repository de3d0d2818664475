"""DATA blocks: rows written in the script or kept in a flat file."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable
from functools import reduce
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime.durable import cut

#: Rows from a cursor, a page or a child that the driver holds at once.
CHUNK = 100_000


def _kind(values: list) -> T.DataType:
    """The narrowest type of a column's JSON values: numbers are doubles, mixed or nested ones text."""
    kinds = {bool: T.BooleanType(), int: T.DoubleType(), float: T.DoubleType(), str: T.StringType()}
    seen = {type(kinds.get(type(v), T.StringType())) for v in values if v is not None}
    return next(k for k in (T.BooleanType(), T.DoubleType(), T.StringType()) if type(k) in seen) if len(seen) == 1 else T.StringType()


def frame(spark: SparkSession, rows: list[list], columns: list[str]) -> DataFrame:
    """DataFrame of JSON-like rows."""
    kinds = [_kind([r[i] for r in rows]) for i in range(len(columns))]

    def cell(v, kind: T.DataType):
        if v is None:
            return None
        if isinstance(kind, T.DoubleType):
            return float(v)
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else json.dumps(v)
        return v

    schema = T.StructType([T.StructField(c, k) for c, k in zip(columns, kinds, strict=True)])
    return spark.createDataFrame([tuple(cell(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows], schema)


def gathered(spark: SparkSession, rows: Iterable[list], columns: list[str], whole: bool = False, chunk: int = CHUNK) -> DataFrame:
    """frame() of rows that come one after the other, of which the driver holds `chunk` at once: more are written to the shared folder.

    With whole, columns of integers alone are bigint."""
    rows = iter(rows)
    held = list(islice(rows, chunk))
    later = next(rows, None)
    types: list[set[type]] = [set() for _ in columns]

    def note(part: list[list]) -> None:
        for own, values in zip(types, zip(*part, strict=True), strict=bool(part)):
            own.update(type(v) for v in values if v is not None)

    note(held)
    if later is None:
        out = frame(spark, held, columns)
    else:
        parts, schema = [], T.StructType([T.StructField("cells", T.ArrayType(T.StringType()))])
        rows = chain([later], rows)
        while held:
            parts.append(cut(spark.createDataFrame([([v if v is None or isinstance(v, str) else json.dumps(v) for v in r],) for r in held], schema)))
            held = list(islice(rows, chunk))
            note(held)
        kinds = [_kind([None if t is type(None) else t() for t in own]) for own in types]
        out = reduce(DataFrame.union, parts).select(*[F.get("cells", F.lit(i)).cast(k).alias(c) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))])
    return out.withColumns({c: F.col(f"`{c}`").cast("bigint") for c, own in zip(columns, types, strict=True) if own == {int}}) if whole else out


def literal(spark: SparkSession, content: str, form: str = "JSON_ARRAY", columns: list[str] | None = None) -> DataFrame:
    """JSON_ARRAY: rows by position; JSON_OBJECTS: by key in any case; CSV: all text, no header."""
    form = form.upper()
    if form == "CSV":
        rows = [r for r in csv.reader(io.StringIO(content.strip()), skipinitialspace=False) if r]
        if not columns:
            raise ValueError("COLUMNS is needed")
        if any(len(r) != len(columns) for r in rows):
            raise ValueError(f"a row has not {len(columns)} cells")
        return spark.createDataFrame([tuple(r) for r in rows], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    data = json.loads(content)
    if form == "JSON_ARRAY":
        if not columns:
            raise ValueError("COLUMNS is needed")
        if any(len(r) != len(columns) for r in data):
            raise ValueError(f"a row has not {len(columns)} cells")
        return frame(spark, data, columns)
    if form == "JSON_OBJECTS":
        columns = columns or (list(data[0]) if data else [])
        rows = []
        for o in data:
            by = {k.lower(): v for k, v in o.items()}
            if missing := [c for c in columns if c.lower() not in by]:
                raise ValueError(f"key {missing[0]} is missing")
            rows.append([by[c.lower()] for c in columns])
        return frame(spark, rows, columns)
    raise ValueError(f"unknown format {form}")
