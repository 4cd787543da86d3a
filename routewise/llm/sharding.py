"""Sharding: sampled splitters over a text key, overfull ranges subdivided, shards of equal size.

A record's key is (64-bit hash of its text, doc_id), so equal texts lie together and no source or
length decides a place.  A size-weighted sample of first keys gives quantile boundaries, which cut the
records into ranges, a fixed number per shard.  The true size of every range is counted; a range of more than
``OVERFULL`` times the mean, as a large group of copies makes it, and one of more than ``RANGE_ROWS`` records
is subdivided by splitters over a hash of the id and a salt that tells fully equal rows apart.  The ranges in a row
make the shards; exact prefix sums over pieces, and a running sum inside each (a bounded number of records),
move the borders between shards to where equal parts of all bytes begin.

Law ``bytes``: sizes of shards differ by less than two records.  Groups (equal texts) stay together
unless a boundary falls inside one.

Defined cases: a null text has size 8 and the checksum of no bytes; ties and repeated rows lie side by
side in any order, each with a slot of its own, however many they are; a null doc_id is the smallest key; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from routewise.llm.common import NO_ID, written
from routewise.sources.tables import read_table

SHARDS = 24
RANGES_PER_SHARD, RANGE_ROWS = 24, 50_000
#: Sampled keys per range, and the size, as a multiple of the mean, beyond which a range is subdivided.
SAMPLES, OVERFULL = 32, 2.0
ROW_BYTES = 8
_UNIT = float(1 << 53)


def _draw(seed: int) -> Column:
    """A number in [0, 1) that a record's key decides, so that a task run again draws alike."""
    return F.shiftrightunsigned(F.xxhash64("key", "id", F.lit(seed)), 11) / F.lit(_UNIT)


def _bisect(bounds: np.ndarray, col: str) -> Column:
    """The number of boundaries at or below a key."""
    @F.arrow_udf("int")
    def place(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.searchsorted(bounds, part.to_numpy(zero_copy_only=False), "right"), pa.int32())
    return place(F.col(col))


def splitters(records: DataFrame, key: str, n: int, total: float, seed: int) -> np.ndarray:
    """At most n - 1 boundaries at quantiles of a size-weighted sample of about SAMPLES * n keys."""
    chance = F.col("size") * F.lit(SAMPLES * n / max(1.0, total))
    keys = np.sort(np.array([r[0] for r in records.where(_draw(seed) < chance).select(key).collect()], np.int64))
    if not len(keys):
        return keys
    return np.unique(keys[(np.arange(1, n) * len(keys)) // n])


def place(records: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to a written table with the columns key, id (64-bit integers), salt (unique) and size.

    The driver sees a sample of SAMPLES keys per range and one row of counts per range; the number of ranges is fixed.
    What lies inside a range, its pieces and their sums, stays in Spark.
    """
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = n_shards * RANGES_PER_SHARD
    ranged = records.withColumn("part", _bisect(splitters(records, "key", n, total, 1), "key"))
    found = {r["part"]: r for r in ranged.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    mean, pieces, bytes_at, rows_at = total / n, [], [0], [0]
    for p in range(n):
        size, count = (found[p]["size"], found[p]["n"]) if p in found else (0, 0)
        overfull = -(-size // max(1.0, mean)) if size > OVERFULL * mean else 1
        pieces.append(int(max(1, overfull, -(-count // RANGE_ROWS))))
        bytes_at.append(bytes_at[-1] + size)
        rows_at.append(rows_at[-1] + count)
    of_part = lambda values: F.array(*[F.lit(v).cast("long") for v in values[:n]])[F.col("part")]
    # hashes of ids and salts are spread evenly, so equal steps over them are their quantiles
    spread = F.shiftrightunsigned(F.xxhash64("id", "salt", F.lit(5)), 11) / F.lit(_UNIT)
    ranged = ranged.withColumn("sub", F.floor(spread * of_part(pieces)))
    counted = ranged.groupBy("part", "sub").agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
    earlier = Window.partitionBy("part").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, at: of_part(at) + F.coalesce(F.sum(c).over(earlier), F.lit(0))
    base = counted.select("part", "sub", before("sum", bytes_at).alias("bytes_before"), before("n", rows_at).alias("rows_before"))
    first = np.full(n_shards + 1, rows, np.int64)  # global row at which a shard starts
    inside = Window.partitionBy("part", "sub").orderBy("key", "id", "crc", "size", "salt")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (ranged.withColumn("bytes_upto", F.sum("size").over(upto)).withColumn("nth", F.row_number().over(inside))
              .join(base, ["part", "sub"])
              .withColumn("start", F.col("bytes_before") + F.col("bytes_upto") - F.col("size"))
              .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
              .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(F.col("start") * n_shards / max(1, total)).cast("int"))))
    placed = written(placed.drop("part", "sub", "salt", "bytes_upto", "nth", "start", "bytes_before", "rows_before"), "placed")
    for r in placed.groupBy("shard").agg(F.min("row").alias("row")).collect():
        first[r["shard"]] = r["row"]
    starts = F.array(*[F.lit(int(x)) for x in first[:n_shards]])
    return placed.withColumn("slot", F.col("row") - starts[F.col("shard")]).drop("row")


def shard_documents(documents: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    records = documents.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64("text").alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.monotonically_increasing_id().alias("salt"))
    return (place(written(records, "records"), n_shards)
            .select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot"))


def write_shards(documents: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Writes the documents to one folder per shard, in slot order inside each file.

    Documents meet their places by (doc_id, text checksum, size); of fully equal rows each keeps a place.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.crc32(text.cast("binary")),
            (F.octet_length(text) + ROW_BYTES).cast("long")]
    rows = documents.select(*[k.alias(f"k{i}_") for i, k in enumerate(keys)], F.struct(*documents.columns).alias("doc_"))
    same = Window.partitionBy("k0_", "k1_", "k2_")
    rows = rows.withColumn("k3_", F.row_number().over(same.orderBy(F.lit(1))))
    placed = shard_documents(documents, n_shards).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k0_"), F.col("text_crc32").alias("k1_"),
        F.col("size").alias("k2_"), "shard", "slot")
    placed = placed.withColumn("k3_", F.row_number().over(same.orderBy("shard", "slot")))
    folder, nth = "shard", "slot"
    while {folder, nth} & set(documents.columns):
        folder, nth = folder + "_", nth + "_"
    out = (rows.join(placed, ["k0_", "k1_", "k2_", "k3_"])
           .select(F.col("shard").alias(folder), F.col("slot").alias(nth), "doc_.*"))
    out.repartitionByRange(folder, nth).sortWithinPartitions(folder, nth).write.partitionBy(folder).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal size."""
    placed = shard_documents(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
