"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Task retries, speculation and spilling are Spark's; these only switch them on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.speculation": "true",
    "spark.speculation.quantile": "0.8",
    "spark.task.maxFailures": "10",
}


def session(master: str | None = None, name: str = "tidemark", **settings: str) -> SparkSession:
    """Get or create the session; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
