"""Connected components of a graph of links: a small graph in one task, any other by rounds of large and small stars; nothing but counters reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Links of a graph that one task joins in memory (16 MB of ids, some times that at work); more are joined by rounds, with the same result.
IN_ONE_TASK = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of the links (u, v) of a whole graph: roots are hooked to the least root they are linked with, until none are."""
    held = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches if b.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v = a[apart], b[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of links (a, b: longs); loops and repeats do no harm, nodes with no other link are left out.

    A large star ties a node's greater neighbours to its least one, a small star
    its lesser neighbours and itself; edges only ever shorten, in logarithmically
    many rounds, until each component is one star. A hot node's rows meet in joins, which are dealt out anew when
    skewed, never in one group."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"))
    if edges.count() <= IN_ONE_TASK:
        small_batches(edges.sparkSession)
        return cut(edges.coalesce(1).mapInArrow(_united, "node long, component long"), edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        edges = cut(small, edges)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR up = 1 AND least = 0").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), edges)
