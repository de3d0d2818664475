"""What the operators of this subpackage share: table access, Arrow batches, durable cuts of lineage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime.durable import delete, freed_shuffles, shared_dir
from ..runtime.ship import ship

#: Bytes that separate words; everything else belongs to a word.
WORD_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of an Arrow batch; documents are a few kB each, so a batch stays at some MB.
BATCH_ROWS = 1000
#: Paths of the cuts that are alive, by scope; those of the outermost one go when the process ends.
_scopes: list[dict[str, SparkSession]] = [{}]


@atexit.register
def _drop_rest() -> None:
    for held in _scopes:
        for path, spark in held.items():
            delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, and see that Python workers can import this package.

    Spark bounds a batch's bytes too (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set), which is what holds for very long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame, *spent: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and no executor's loss undoes it.

    The job's shuffle files go with the job's end, and with them the cuts in
    `spent`, whose last reader this was. What is left goes with the innermost
    `scope`, or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    with freed_shuffles(spark):
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    _scopes[-1][path] = spark
    drop(*spent)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete cuts that nothing reads any more; other frames are passed over."""
    for df in cuts:
        path = df.__dict__.get("_cut_path")
        for held in _scopes:
            if path in held:
                delete(held.pop(path), path)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Cuts made inside go at the end, but for those passed to the function that this gives, which outlive it."""
    held: dict[str, SparkSession] = {}
    above = _scopes[-1]
    _scopes.append(held)

    def outlive(df: DataFrame) -> DataFrame:
        if (path := df.__dict__.get("_cut_path")) in held:
            above[path] = held.pop(path)
        return df

    try:
        yield outlive
    finally:
        _scopes.pop()
        for path, spark in held.items():
            delete(spark, path)


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, binary_text: bool = False) -> DataFrame:
    """mapInArrow with plain lists in and out, batch by batch.

    With binary_text the column `text` arrives as bytes (None stays None)."""
    spark = df.sparkSession
    small_batches(spark)
    fields = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {}
            for i, name in enumerate(batch.schema.names):
                col = batch.column(i)
                if binary_text and name == "text":
                    col = col.cast(pa.binary())
                cols[name] = col.to_pylist()
            out = fn(cols)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
