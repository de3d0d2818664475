"""Fixed windows over a bounded series: the time-weighted mean of each window and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import with_next


def downsample(df: DataFrame, keys: list[str], time: str, value: str, start: str, finish: str, every: str) -> DataFrame:
    """keys, window_start and value, the mean of the step function over each window from start to finish.

    Each point spreads over the windows that it holds in, so a group's rows are
    cut by window and never meet in one list. Windows before a group's first
    point are left out; the last point holds to the finish."""
    t, end = F.col(time).cast("timestamp"), F.lit(finish).cast("timestamp")
    begin = F.lit(start).cast("timestamp")
    points = df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).withColumn("__t", t)
    points = with_next(points.withColumn("__s", F.unix_micros("__t") / F.lit(1e6)), keys, "__s", "__n")
    later = F.timestamp_micros(F.round(F.col("__n") * 1e6).cast("long"))
    held = points.withColumn("__from", F.greatest("__t", begin)).withColumn("__to", F.least(F.coalesce(later, end), end)).where("__to > __from")
    step = F.expr(f"INTERVAL {every}")
    micros = lambda c: F.unix_micros(c)
    width = micros(begin + step) - micros(begin)
    first = F.floor((micros(F.col("__from")) - micros(begin)) / width)
    last = F.floor((micros(F.col("__to")) - 1 - micros(begin)) / width)
    spread = held.select(*keys, F.col(value).cast("double").alias("__v"), "__from", "__to", F.explode(F.sequence(first, last)).alias("__k"), width.alias("__w"), micros(begin).alias("__b"))
    w0: Column = F.col("__b") + F.col("__k") * F.col("__w")
    hold = F.least(micros(F.col("__to")), w0 + F.col("__w")) - F.greatest(micros(F.col("__from")), w0)
    out = spread.groupBy(*keys, F.timestamp_micros(w0).alias("window_start")).agg(F.sum(F.col("__v") * hold).alias("s"), F.sum(hold).alias("h"), F.max("__w").alias("w"))
    return out.where("h = w").select(*keys, "window_start", (F.col("s") / F.col("h")).alias(value))
