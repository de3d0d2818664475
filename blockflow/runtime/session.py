"""A session with the settings the engine expects; a cluster's own come from spark-submit."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("blockflow")
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    return builder.config(map=base | settings).getOrCreate()
