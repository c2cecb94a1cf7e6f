"""The folder that all executors share, for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests, local mode), a temporary one of this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortgeo-"))
        found = context.getCheckpointDir()
    return found


def materialize(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read back: lineage is cut and no lost executor can lose it.

    The files go when the driver's JVM ends, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cohortgeo-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
