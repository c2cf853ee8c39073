"""A Spark session with the settings that the library's results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """UTC times, adaptive execution, and repeated map keys resolved to the last."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on find this package where the driver found it.

    For sessions whose workers share the driver's file system; on a cluster the package is
    installed on every machine, and this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
