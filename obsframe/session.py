"""A session with this library's settings; on a cluster, spark-submit's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, name: str = "obsframe", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive plans, one shuffle partition a core."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "6g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.local.dir": os.environ.get("TMPDIR", "/tmp"),
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver does.

    On a cluster ship it with --py-files; there this changes nothing.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, paths]))
