"""A session with the settings that the queries' results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "lodespar", **settings: str) -> SparkSession:
    """Time zone UTC; Spark's own adaptive execution picks join strategies and partition counts. ``settings``: by name, with _ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
