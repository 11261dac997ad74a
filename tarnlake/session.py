"""Sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # what was checkpointed goes when nothing refers to it
}


def session(app: str = "tarnlake", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword settings use ``__`` for dots. Object-store options (endpoint, keys) pass through as ``spark__hadoop__...``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
