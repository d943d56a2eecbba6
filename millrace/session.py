"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution re-plans joins, splits skewed partitions and merges small
#: ones at any size; nothing here depends on the size of the data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "millrace", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` override them (dots as ``__``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, ``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
