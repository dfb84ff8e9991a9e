"""Sources and sinks: delimited files of trials, list literals, generated arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import list_literal, threshold_in

#: The columns of a file of trials; the first has no name in the header.
TRIALS = "_c0 int, time double, cost double, num_lambdas int, aggregate_duration double, min_duration double, max_duration double, avg_duration double"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", glob: str | None = None) -> DataFrame:
    """With a header and a given schema, so that no pass infers types."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep)
    return (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)


def from_pandas(spark: SparkSession, frame: pd.DataFrame, n: int = 10) -> DataFrame:
    """A small table of the driver in n partitions."""
    return spark.createDataFrame(frame).repartition(n)


def read_with_threshold(spark: SparkSession, path: str, schema: str, glob: str = "*.csv") -> DataFrame:
    """All files below a folder whose names match, with the number after seq= in each row's path."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path)
    return rows.withColumn("threshold", threshold_in(F.input_file_name()))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Files of one-line list literals: (numbers array<bigint>)."""
    return spark.read.text(path).select(list_literal(F.col("value")).alias("numbers"))


def write_lists(df: DataFrame, path: str, column: str) -> None:
    df.select(F.to_json(column)).write.mode("overwrite").text(path)


def push(df: DataFrame, path: str, batch: int) -> None:
    """Adds rows, such as the metrics of tasks, to a list in a folder as batch number `batch`; the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def pushed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the list, each with its batch: the larger, the later."""
    return spark.read.schema(f"{schema}, batch int").parquet(path)


def random_numbers(spark: SparkSession, n: int, low: int = -1000, high: int = 1000, seed: int = 42) -> DataFrame:
    """(pos, v): n whole numbers between low and high, both included."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long").alias("v"))
