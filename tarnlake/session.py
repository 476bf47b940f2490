"""Session factory. Queries work in any session; this one pins what the dialect needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic, "name" as an identifier, adaptive plans, and pushdown for the scans.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def make_session(master: str | None = None, name: str = "tarnlake", **settings: str) -> SparkSession:
    """A session with SETTINGS. master: None leaves the choice to spark-submit. Further settings
    by name, with __ for a dot: spark__sql__shuffle__partitions="8"."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
