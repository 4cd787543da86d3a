"""Sinks: feature table and importance table writers (shared storage only)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from routewise.session import written_root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table of this application, in the shared folder."""
    return f"{written_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a written folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_features(features: DataFrame, path: str, partitions: int | None = None) -> None:
    """SNK1: range-partitioned by tick, sorted (tick, txn_id) inside files,
    partitioned on disk by dataset_split so split filters prune files."""
    n = partitions or int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (features.repartitionByRange(n, "tick", "txn_id")
     .sortWithinPartitions("tick", "txn_id")
     .write.mode("overwrite").partitionBy("dataset_split").parquet(path))


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC3 reader: a split filter becomes partition pruning."""
    df = spark.read.parquet(path)
    return df.where(df.dataset_split == split) if split else df


def write_csv(df: DataFrame, path: str) -> None:
    """SNK2: small report tables as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
