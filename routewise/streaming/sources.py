"""Decision and outcome event streams derived from the attempts table.

decision_ts = attempt ts; outcome_ts = ts + latency_ms minutes (so callbacks with latency > 60 fall
outside the 1 h pending window); every txn_id % 10 = 0 outcome is delivered twice (retries).  With
``gaps`` (only where lost events are the subject) outcomes of txn_id % 50 = 0 never arrive (expired
decisions) and decisions of txn_id % 50 = 1 are missing (orphan outcomes).  The derived tables are
written in time order to the shared folder and replayed with a file stream source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routewise.sources.bindings import EPOCH_2024
from routewise.sources.sinks import shared_path

DECISION_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()), T.StructField("decision_ts", T.TimestampType()),
    T.StructField("tick", T.LongType()), T.StructField("amount", T.DoubleType()),
    T.StructField("bank", T.StringType()), T.StructField("network", T.StringType()),
    T.StructField("payment_method", T.StringType()), T.StructField("merchant", T.StringType()),
    T.StructField("device", T.StringType()), T.StructField("risk", T.StringType()),
    T.StructField("route_id", T.StringType()),
])
OUTCOME_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()), T.StructField("attempt_ts", T.TimestampType()),
    T.StructField("outcome_ts", T.TimestampType()), T.StructField("tick", T.LongType()),
    T.StructField("bank", T.StringType()), T.StructField("network", T.StringType()),
    T.StructField("route_id", T.StringType()), T.StructField("success", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
])
#: Requests and outcomes as one stream, in the order of delivery (``slice``).
ARRIVAL_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("arrival_ts", T.TimestampType()), T.StructField("arrived", T.LongType()),
    *[f for f in DECISION_SCHEMA if f.name != "decision_ts"],
    T.StructField("success", T.IntegerType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("slice", T.LongType()),
])
#: Seconds after which the callbacks that are delivered twice come again.
REDELIVERY = 1800


def decisions(attempts_ts: DataFrame, gaps: bool = False) -> DataFrame:
    kept = attempts_ts.where(F.col("txn_id") % 50 != 1) if gaps else attempts_ts
    return kept.select("txn_id", F.col("ts").alias("decision_ts"), "tick", "amount", "bank", "network",
                       "payment_method", "merchant", "device", "risk", "route_id")


def outcomes(attempts_ts: DataFrame, gaps: bool = False) -> DataFrame:
    base = attempts_ts.where(F.col("txn_id") % 50 != 0) if gaps else attempts_ts
    base = base.select(
        "txn_id", F.col("ts").alias("attempt_ts"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("latency_ms").cast("int"))).alias("outcome_ts"),
        "tick", "bank", "network", "route_id", "success", "latency_ms")
    return base.unionByName(base.where(F.col("txn_id") % 10 == 0))


def write_time_ordered(df: DataFrame, path: str, ts_col: str, batches: int = 4, files: int = 8,
                       close_after: int = 0) -> str:
    """Write a replay source: ``batches * files`` files in time order, in one pass over many tasks.

    A live deployment reads the event bus instead.  The rows are range-partitioned by event time; the
    file source takes files by modification time, so these are set in the order of the ranges (one call
    per file).  Rows that only move the clock (``txn_id`` null) follow in a last file, ``close_after``
    seconds beyond the last event: a stream that ends would otherwise never pass its last ticks.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def names() -> list[str]:
        return sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))

    df.repartitionByRange(batches * files, ts_col).write.mode("overwrite").parquet(path)
    ordered = names()
    if close_after:
        stamps = [c for c, t in df.dtypes if t == "timestamp"]
        last = df.agg(F.max(ts_col).alias("last")).where(F.col("last").isNotNull())
        beat = last.select(*[(F.col("last") + F.make_dt_interval(secs=F.lit(close_after))).alias(c) if c in stamps
                             else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        beat.coalesce(1).write.mode("append").parquet(path)   # one row
        ordered += [n for n in names() if n not in set(ordered)]
    start = fs.getFileStatus(folder).getModificationTime()
    for i, n in enumerate(ordered):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(folder, n), start - 1000 * (len(ordered) - i), -1)
    return path


def materialise_decisions(spark: SparkSession, attempts_ts: DataFrame, gaps: bool = False, batches: int = 4,
                          files: int = 8, close_after: int = 10 * 86400) -> str:
    path = f"{shared_path(spark, 'streams')}/decisions"
    return write_time_ordered(decisions(attempts_ts, gaps), path, "decision_ts", batches, files, close_after)


def materialise_outcomes(spark: SparkSession, attempts_ts: DataFrame, gaps: bool = False, batches: int = 4,
                         files: int = 8, close_after: int = 10 * 86400) -> str:
    path = f"{shared_path(spark, 'streams')}/outcomes"
    return write_time_ordered(outcomes(attempts_ts, gaps), path, "outcome_ts", batches, files, close_after)


def materialise_streams(spark: SparkSession, attempts_ts: DataFrame, gaps: bool = False, batches: int = 4,
                        files: int = 8, close_after: int = 10 * 86400) -> tuple[str, str]:
    return (materialise_decisions(spark, attempts_ts, gaps, batches, files, close_after),
            materialise_outcomes(spark, attempts_ts, gaps, batches, files, close_after))


def read_decisions(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    return spark.readStream.schema(DECISION_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def read_outcomes(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    return spark.readStream.schema(OUTCOME_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def arrivals(attempts_ts: DataFrame, tick_seconds: int, slice_seconds: int) -> DataFrame:
    """Requests and outcomes with the tick of their arrival; every txn_id % 10 = 0 outcome comes again later."""
    since = lambda ts: F.unix_seconds(ts) - F.lit(EPOCH_2024)
    common = [f.name for f in DECISION_SCHEMA if f.name != "decision_ts"]
    request = attempts_ts.select(F.lit("request").alias("kind"), F.col("ts").alias("arrival_ts"), *common,
                                 F.lit(None).cast("int").alias("success"), F.lit(None).cast("double").alias("latency_ms"),
                                 F.lit(0).alias("again"))
    done = F.col("ts") + F.make_dt_interval(mins=F.col("latency_ms").cast("int"))
    times = F.when(F.col("txn_id") % 10 == 0, F.array(F.lit(0), F.lit(REDELIVERY))).otherwise(F.array(F.lit(0)))
    outcome = attempts_ts.select(F.lit("outcome").alias("kind"), done.alias("arrival_ts"), *common, "success", "latency_ms",
                                 F.explode(times).alias("again"))
    x = request.unionByName(outcome)
    return x.select("kind", "arrival_ts", F.floor(since(F.col("arrival_ts")) / tick_seconds).cast("long").alias("arrived"), *common,
                    "success", "latency_ms", F.floor((since(F.col("arrival_ts")) + F.col("again")) / slice_seconds).cast("long").alias("slice"))


def write_slices(df: DataFrame, path: str, files: int = 1) -> str:
    """Write a replay source with ``files`` files per ``slice``, taken in the order of the slices.

    A live deployment reads the event bus instead.  The file source takes files by modification time, so
    these are set in that order (one call per file).  Rows of a slice are dealt by a hash, so that as many tasks
    write and read it; a slice that got fewer files is filled up with empty ones.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, conf = hadoop.Path(path), spark._jsc.hadoopConfiguration()
    fs = folder.getFileSystem(conf)
    df.repartition("slice", F.pmod(F.xxhash64("txn_id"), F.lit(files))).write.mode("overwrite").partitionBy("slice").parquet(path)
    empty = f"{path}-empty"
    spark.createDataFrame([], df.drop("slice").schema).coalesce(1).write.mode("overwrite").parquet(empty)
    blank = next(f.getPath() for f in fs.listStatus(hadoop.Path(empty)) if f.getPath().getName().startswith("part-"))
    parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("slice=")]
    parts.sort(key=lambda p: int(p.getName().split("=")[1]))
    start = fs.getFileStatus(folder).getModificationTime()
    for i, part in enumerate(parts):
        for k in range(len(fs.listStatus(part)), files):
            hadoop.FileUtil.copy(fs, blank, fs, hadoop.Path(part, f"part-none-{k}.parquet"), False, conf)
        for f in fs.listStatus(part):
            fs.setTimes(f.getPath(), start - 1000 * (len(parts) - i), -1)
    return path


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """One slice per micro-batch: all slices have the same number of files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("slice=")]
    files = max(1, len(fs.listStatus(parts[0]))) if parts else 1
    return spark.readStream.schema(ARRIVAL_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
