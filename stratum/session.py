"""The session that tests, the bench and the command line use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", name: str = "stratum", **conf: str) -> SparkSession:
    """UTC, adaptive execution, and whatever ``conf`` adds (underscores stand for dots)."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
