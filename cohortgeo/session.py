"""Sessions, and the package's place for Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution and Arrow. Not for clusters: those bring their own."""
    return with_package(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortgeo")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def with_package(spark: SparkSession) -> SparkSession:
    """Python workers of this session find the package where the driver has it, whatever the working folder."""
    found = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, found]) if found else ROOT
    return spark
