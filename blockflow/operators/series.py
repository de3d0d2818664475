"""The next point of a time series, without a task that holds a series as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a series that meet in one task.
SLICE = 3600


def with_next(df: DataFrame, keys: list[str], seconds: str, name: str) -> DataFrame:
    """df with the column `name`: the time in `seconds` of the point that follows within the keys; null for the last.

    Series are cut into slices of time, so that one with very many points is dealt
    out. Inside a slice the next point comes from a window; a slice's last point
    takes the first one of the next slice that has any, a row a slice. Of points
    at the same time all but one are followed by that time."""
    own = [F.col(f"`{k}`") for k in keys]
    at = F.floor(F.col(seconds) / SLICE)
    points = Window.partitionBy(*own, at).orderBy(F.col(seconds))
    cut = df.withColumn("__slice", at).withColumn("__later", F.lead(seconds).over(points)).withColumn("__first", F.row_number().over(points) == 1)
    firsts = cut.where(F.col("__first") & F.col("__slice").isNotNull()).select(*[c.alias(f"__key_{i}") for i, c in enumerate(own)], F.col("__slice").alias("__of"), F.col(seconds).alias("__at"))
    slices = Window.partitionBy(*[F.col(f"__key_{i}") for i in range(len(own))] or [F.lit(1)]).orderBy("__of")
    nexts = firsts.withColumn("__next", F.lead("__at").over(slices)).drop("__at")
    same: Column = F.col("__slice") == F.col("__of")
    for i, c in enumerate(own):
        same = same & c.eqNullSafe(F.col(f"__key_{i}"))
    joined = cut.join(nexts, same, "left").withColumn(name, F.coalesce("__later", "__next"))
    return joined.drop("__slice", "__later", "__first", "__of", "__next", *[f"__key_{i}" for i in range(len(own))])
