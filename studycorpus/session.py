"""Session settings the library expects. A cluster sets its own sizes."""
from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "studycorpus", master: str | None = None, **extra: str) -> SparkSession:
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               # call-site capture makes every Python column call several times slower
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
