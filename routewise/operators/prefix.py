"""Strictly-prior aggregates in transaction order, without hot-key tasks.

A direct ``Window.partitionBy(bank).orderBy(txn_id)`` puts every row of a
bank into one task; with a handful of banks (or one bank holding a third of
the traffic) that is a handful of tasks at any scale.  The blocked form
splits the order key into fixed-width blocks of ``txn_id``:

1. per (key, block) partial aggregate (tiny table: keys x blocks);
2. prefix over blocks on that table (exclusive: previous blocks only);
3. inside each (key, block) a running window over at most ``block_size``
   rows; the exchange is hashed by (key, block), so a hot key spreads over
   all its blocks;
4. combine = prefix of previous blocks (+) prior rows inside the block.

Exact for sums, counts and "last value" (txn_id is unique, so the order
inside a block is total).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewise.plans.materialize import checkpointed

DEFAULT_BLOCK_SIZE = 1 << 20


def block_of(order_col: str, block_size: int) -> Column:
    return F.expr(f"{order_col} div {int(block_size)}")


def block_prefix(blocks: DataFrame, keys: Sequence[str], sums: Sequence[str] = (),
                 lasts: Sequence[str] = ()) -> DataFrame:
    """Exclusive prefix over blocks: sums of, and last non-null of, previous blocks."""
    w = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.col(k) for k in keys] + [F.col("block")]
    out += [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"prev_{c}") for c in sums]
    out += [F.last(c, ignorenulls=True).over(w).alias(f"prev_{c}") for c in lasts]
    return blocks.select(*out)


def in_block_window(keys: Sequence[str], order_col: str = "txn_id") -> Window:
    return (Window.partitionBy(*keys, "block").orderBy(order_col)
            .rowsBetween(Window.unboundedPreceding, -1))


#: Ranges at least; a session with more shuffle partitions, as a larger cluster has, gets as many.
RANGES = 256


def ranges_of(df: DataFrame) -> int:
    return max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ordered_prefix(df: DataFrame, score: str, sums: Sequence[str], descending: bool = False,
                   ranges: int | None = None) -> DataFrame:
    """Inclusive running sums over distinct values of ``score`` in a global order.

    Global order without one task: rows are aggregated per distinct score
    and the distinct scores are written in ``ranges`` ranges cut at sampled
    quantiles, so ranges hold about equally many however the scores crowd.
    Range totals get an exclusive prefix (a table of ``ranges`` rows), and
    inside a range a window runs over its distinct scores only.  Returns one
    row per distinct score with ``cum_<col>``.  Runs a Spark job (the write).
    """
    s = F.col(score)
    order = s.desc() if descending else s.asc()
    g = df.groupBy(score).agg(*[F.sum(c).alias(c) for c in sums])
    g = checkpointed(g.repartitionByRange(ranges or ranges_of(df), order).withColumn("_b", F.spark_partition_id()), "ranges")
    tot = g.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_p_{c}") for c in sums])
    wi = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("*", *[F.sum(c).over(wi).alias(f"_i_{c}") for c in sums])
    out = g.join(F.broadcast(tot), "_b", "left")  # at most ``ranges`` rows
    return out.select(score, *sums, *[(F.col(f"_i_{c}") + F.coalesce(F.col(f"_p_{c}"), F.lit(0))).alias(f"cum_{c}")
                                      for c in sums])


def global_position(df: DataFrame, major: str, minor: str, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """0-based position of each row in the total order (major, minor), minor unique.

    Offsets: rows in earlier ``major`` values (prefix over a table of one
    row per major value) + rows in earlier minor-blocks of the same major
    value + rank inside the (major, block) -- no single-task sort of rows.
    """
    d = df.withColumn("_blk", block_of(minor, block_size))
    cnt = d.groupBy(major, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    per_major = cnt.groupBy(major).agg(F.sum("_n").alias("_nm"))
    wm = Window.orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    per_major = per_major.select(major, F.coalesce(F.sum("_nm").over(wm), F.lit(0)).alias("_om"))
    wb = Window.partitionBy(major).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.select(major, "_blk", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_ob"))
    offsets = cnt.join(per_major, major)
    rn = F.row_number().over(Window.partitionBy(major, "_blk").orderBy(minor)) - 1
    d = d.select("*", rn.alias("_rn"))
    return (d.join(offsets, [major, "_blk"], "left")
            .select(*df.columns, (F.col("_om") + F.col("_ob") + F.col("_rn")).alias("position")))
