"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets one task keep a writer open for clean and for rejected rows, instead of sorting them.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # Recording the Python line of every column expression takes longer than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "tallyreach", master: str | None = None, **settings) -> SparkSession:
    """``settings`` use underscores for dots and win over the defaults."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    chosen = {**SETTINGS, **{key.replace("_", "."): value for key, value in settings.items()}}
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
