"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where none is set and driver and executors are one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ramify-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """Where the tables of this application are, in the shared folder."""
    return f"{shared_dir(spark)}/ramify/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, among those of this application, that nothing uses yet."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs no rework."""
    at = fresh(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def flush(spark: SparkSession) -> bool:
    """Removes all that this application has written to the shared folder, and says whether there was anything.

    Results are read from there when they are used, so those not yet saved elsewhere are gone with it. Other applications'
    tables stay.
    """
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return bool(at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True))
