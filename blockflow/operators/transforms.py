"""The transforms that a TRANSFORM block may name by its first word."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import aggregate, apply, lookup, streams


def kind_of(body: str) -> str:
    words = body.split(None, 1)
    kind = words[0].lower() if words else ""
    if kind not in ("aggregate", "apply", "lookup"):
        raise SyntaxError(f"unknown transform {words[0] if words else '(empty)'}")
    return kind


def check(body: str) -> None:
    {"aggregate": aggregate.parse, "apply": apply.parse, "lookup": lookup.parse}[kind_of(body)](body)


def transform(sources: dict[str, DataFrame], body: str, sequential: bool = False) -> DataFrame:
    """Runs the body over named sources; those of AGGREGATE and APPLY are put together first."""
    kind = kind_of(body)
    if kind == "lookup":
        return lookup.lookup(sources, body)
    frames = list(sources.values())
    df = frames[0] if len(frames) == 1 else (streams.ordered_fan_in if sequential else streams.fan_in)(frames)
    return (aggregate.aggregate if kind == "aggregate" else apply.apply)(df, body)
