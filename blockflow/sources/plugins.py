"""Row plugins: child processes that speak JSON-RPC, a line a message, on their standard streams."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime.durable import cut
from ..runtime.ship import ship

#: Rows of one call; the protocol takes any number.
ROWS = 500


class Child:
    def __init__(self, command: list[str]):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self.calls = 0

    def call(self, method: str, *params):
        self.calls += 1
        self.process.stdin.write(json.dumps({"jsonrpc": "2.0", "id": self.calls, "method": method, "params": list(params)}) + "\n")
        self.process.stdin.flush()
        line = self.process.stdout.readline()
        if not line:
            raise RuntimeError(f"plugin ended during {method}")
        answer = json.loads(line)
        if answer.get("error"):
            raise RuntimeError(f"plugin failed in {method}: {answer['error']}")
        return answer.get("result")

    def close(self) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait(timeout=30)


def start(command: list[str], options: dict, sources: dict[str, list[str]], sinks: list[str]) -> tuple[Child, dict[str, list[str]]]:
    child = Child(command)
    for k, v in options.items():
        child.call("set_option", k, v)
    child.call("set_sources", list(sources))
    child.call("set_destinations", sinks)
    for name, columns in sources.items():
        child.call("set_input_columns", name, columns)
    return child, child.call("get_output_columns") or {}


def plugin_transform(sources: dict[str, DataFrame], sinks: list[str], command: list[str], options: dict | None = None, sequential: bool = False) -> dict[str, DataFrame]:
    """Destination -> rows. Each partition has a child of its own; sequential sources pass through a single one, in order.

    Output columns that an input has by name keep its type; others are text."""
    spark = next(iter(sources.values())).sparkSession
    ship(spark)
    columns = {n: df.columns for n, df in sources.items()}
    child, outputs = start(command, options or {}, columns, sinks)
    child.close()
    types = {f.name.lower(): f.dataType for df in sources.values() for f in df.schema}
    tagged = []
    for k, (name, df) in enumerate(sources.items()):
        cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        tagged.append(df.select(F.lit(k).alias("k"), F.lit(name).alias("source"), cells.alias("cells"), F.monotonically_increasing_id().alias("i")))
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.union(t)
    if sequential:
        rows = rows.repartition(1).sortWithinPartitions("k", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = start(command, options or {}, columns, sinks)

        def answered(result) -> pd.DataFrame:
            found = [(r.get("destination", ""), json.dumps(r["data"])) if isinstance(r, dict) else ("", json.dumps(r)) for r in (result or {}).get("rows") or []]
            return pd.DataFrame(found, columns=["destination", "cells"], dtype="object")

        for batch in batches:
            messages = [{"source": s, "destination": "", "data": [json.loads(c)[n] for n in columns[s]]} for s, c in zip(batch["source"], batch["cells"], strict=True)]
            for at in range(0, len(messages), ROWS):
                yield answered(own.call("receive", messages[at : at + ROWS]))
        yield answered(own.call("receive", None))
        own.close()

    result = rows.mapInPandas(run, "destination string, cells string")
    if len(sinks or outputs) > 1:  # one run of the children, whatever number of destinations reads from it
        result = cut(result)
    out = {}
    for name in sinks or list(outputs):
        names = outputs.get(name) or next(iter(outputs.values()))
        parsed = F.from_json("cells", T.ArrayType(T.StringType()))
        mine = result.where((F.col("destination") == name) | (F.col("destination") == "")).select(parsed.alias("c"))
        out[name] = mine.select(*[F.get("c", F.lit(i)).cast(types.get(n.lower(), T.StringType())).alias(n) for i, n in enumerate(names)])
    return out


def plugin_source(spark: SparkSession, command: list[str], options: dict | None = None) -> DataFrame:
    """Rows that a child gives until it has no more."""
    from .literal import gathered

    child = Child(command)
    for k, v in (options or {}).items():
        child.call("set_option", k, v)
    outputs = child.call("get_output_columns")
    names = outputs if isinstance(outputs, list) else next(iter(outputs.values()))

    def rows() -> Iterator[list]:
        while got := (child.call("receive") or {}).get("rows"):
            yield from (r["data"] if isinstance(r, dict) else r for r in got)

    out = gathered(spark, rows(), names)
    child.close()
    return out


def plugin_sink(df: DataFrame, command: list[str], options: dict | None = None, source: str = "source") -> None:
    """Hands all rows to children, one a partition."""
    ship(df.sparkSession)
    columns = df.columns

    def run(rows) -> None:
        child = Child(command)
        for k, v in (options or {}).items():
            child.call("set_option", k, v)
        child.call("set_input_columns", source, columns)
        held = []
        for r in rows:
            held.append([v if isinstance(v, (int, float, str, bool, type(None))) else str(v) for v in r])
            if len(held) == ROWS:
                child.call("receive", held)
                held = []
        if held:
            child.call("receive", held)
        child.call("receive", None)
        child.close()

    df.foreachPartition(run)
