"""Sinks that can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Rows stamped with their run; writing a run again replaces it and leaves the others."""
    df.withColumn("run_ts", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(path)


def gathered(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df``, a written table, dealt by ranges of its partitions and, inside one, of hashes of its rows: all tasks write about as many files as there are
    partitions and tasks, not one per task in each partition, and a large partition is not left to one task."""
    row = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return df.repartitionByRange(*[F.col(c) for c in partition_by], F.xxhash64(*row))


def replace_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Only the partitions that ``df``, a written table, has rows for are written anew."""
    gathered(df, *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def text_metrics(df: DataFrame, path: str) -> None:
    """A small table of metrics as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
