"""Session defaults for local runs; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("tidegrid")
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
