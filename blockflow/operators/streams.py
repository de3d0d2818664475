"""Fan-in, fan-out by name, and filters on whole rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_in(sources: list[DataFrame]) -> DataFrame:
    """Rows of all sources, columns by position under the first one's names."""
    width = len(sources[0].columns)
    if any(len(s.columns) != width for s in sources):
        raise ValueError("sources of one node must have equally many columns")
    return reduce(DataFrame.union, sources)


def ordered_fan_in(sources: list[DataFrame]) -> DataFrame:
    """fan_in with all rows of a source before those of the next, each in its own order."""
    tagged = [s.withColumns({"__source": F.lit(k), "__order": F.monotonically_increasing_id()}) for k, s in enumerate(sources)]
    return fan_in(tagged).orderBy("__source", "__order").drop("__source", "__order")


def route(df: DataFrame, by: str, names: list[str]) -> dict[str, DataFrame]:
    """Rows for each destination; a null name goes to all, an unknown one to none."""
    return {n: df.where(F.col(by).isNull() | (F.col(by) == n)).drop(by) for n in names}


def drop_nulls(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.na.drop("any")
