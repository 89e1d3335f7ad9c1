"""Sessions whose Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def find_package(spark: SparkSession) -> SparkSession:
    """Puts the folder of this package on the path of Python workers that start from now on."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in one process, for tests and small crawls."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weftspan")
    settings = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g", **conf}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return find_package(builder.getOrCreate())
