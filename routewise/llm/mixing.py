"""Mixing sources to target weights by entropy balancing.

Every source gets a target number of words.  Document rates stay as near to 1 as the targets allow, in the
sense of relative entropy over documents, with no rate above ``MOST``: the solution tilts a document's rate
exponentially by its size, rate = min(MOST, exp(lambda * size / mean size)), with one multiplier per
source, the minimum of a convex dual.  Newton steps, kept inside a bracket that each evaluation narrows,
find all multipliers at once: one Spark job a step, over a histogram of (source, size), so every document
counts and none is read again.  Its sums are exact decimals, so no order of addition changes a result.

Rates become copies in two parts.  The whole part goes to every document.  The rest is a number of extra
copies per (source, size), carried from the largest size to the smallest, so that what one size rounds off
the next takes up, and a source ends within about half its smallest document of its target.  Within a
(source, size) the extras go to the first documents by a hash of the id; their places come from one
sort over all tasks and the counts of its parts, so neither a source nor a group of copies meets in one task.

Defined cases: a null text has no words; a null source is a source of its own, the last one; documents
without words have rate 1 and take nothing; a target of 0 takes nothing, one at the bound takes every document
``MOST`` times; fully equal rows take each their place, in any order; an empty table gives no rows;
extra columns pass through unread under ``doc_``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from routewise.llm.common import chunks, text_bytes, written
from routewise.sources.tables import read_table

#: Source weights by code point of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document, and so no source, is taken more often.
MOST = 3
#: Steps end when every source is this near its target, relatively; those after the first NEWTON_STEPS halve the bracket.
NEAR, NEWTON_STEPS, STEPS = 1e-9, 20, 80
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
EXACT = "decimal(38,12)"


def count_words(text: bytes) -> int:
    word = ~SPACES[np.frombuffer(text, np.uint8)]
    return int(np.count_nonzero(word[1:] & ~word[:-1]) + word[:1].sum())


def sized(documents: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``doc_`` (all columns, or those named), source, id_ (hash of the id) and size in words."""
    id_ = F.xxhash64("doc_id", F.lit(12))
    rows = documents.select(F.struct(*(columns or documents.columns)).alias("doc_"), "source", id_.alias("id_"), text_bytes().alias("text"))
    fields = rows.drop("text").schema.fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                sizes = pa.array([count_words(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sizes], names=[*names, "size"])

    return rows.mapInArrow(run, StructType([*fields, StructField("size", LongType())]))


def histogram(rows: DataFrame) -> DataFrame:
    """Documents ``n`` of every (source, size)."""
    return written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")


def targets(hist: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target: shares of all words by weight, none above ``most`` times its source.

    What the bound takes from a source is shared by weight among those below it, until none is above.
    """
    rows = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs"))
    # the place in code point order, sorted in ranges: sources may be many
    parts = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    rows = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    rows = written(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = rows.groupBy("part").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    parts = parts.select("part", "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"))
    place = (F.col("at") - F.col("first") + F.col("k")) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place.cast("int") + 1)
    rows = written(rows.join(parts, "part").select("source", "source_size", "n_docs", weight.alias("weight")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, bound = None, F.col("source_size") * most
    while True:  # one row a round: the share of a weight of 1 among sources below their bound
        above = F.lit(False) if share is None else F.col("weight") * share > bound
        r = rows.agg(F.sum(F.when(above, bound)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("weight"),
                     F.sum(above.cast("long")).alias("n")).first()
        new = (total - (r["taken"] or 0)) / r["weight"] if r["weight"] else math.inf
        if share is not None and (r["n"] == n_above or not r["weight"]):
            break
        share, n_above = new, r["n"] or 0
    target = F.least(bound.cast("double"), F.col("weight") * F.lit(float(share)))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def _tilted(step: str, most: int) -> tuple[Column, Column]:
    """The rate of a size under a multiplier, and whether it stays below the bound."""
    tilt = F.try_divide(F.col(step) * F.col("size"), F.col("mean"))
    below = tilt < math.log(most)
    return F.when(below, F.exp(tilt)).otherwise(float(most)), below


def multipliers(hist: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, mean and ``lambda`` of every source; null where the target is 0 or at its bound."""
    inside = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most) & (F.col("source_size") > 0)
    mean = F.col("source_size") / F.col("n_docs")
    # a size of 1 tilts least: at the low end it falls to target / source_size, at the high end it stands at the bound
    low = F.least(F.lit(0.0), F.log(F.try_divide(F.col("target"), F.col("source_size")))) * mean - 1
    state = wanted.select("source", "source_size", "target", mean.alias("mean"), inside.alias("inside"),
                          F.lit(0.0).alias("step"), low.alias("low"), (F.lit(math.log(most)) * mean + 1).alias("high"))
    state = written(state, "multipliers")
    rate, below = _tilted("step", most)
    for k in range(STEPS):
        named = state.where("inside").select(F.col("source").alias("source_"), "mean", "step")
        words = F.col("n") * F.col("size") * rate
        bend = F.when(below, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (hist.join(named, F.col("source").eqNullSafe(F.col("source_"))).groupBy(F.col("source_"))
                .agg(F.sum(words.cast(EXACT)).cast("double").alias("words"), F.sum(bend.cast(EXACT)).cast("double").alias("bend")))
        rows = state.join(sums, F.col("source").eqNullSafe(F.col("source_")), "left")
        miss = F.col("words") - F.col("target")
        done = ~F.col("inside") | (F.abs(miss) <= F.lit(NEAR) * F.col("target")) | F.col("words").isNull()
        rows = (rows.withColumn("done", done).withColumn("low", F.when(miss < 0, F.col("step")).otherwise(F.col("low")))
                .withColumn("high", F.when(miss > 0, F.col("step")).otherwise(F.col("high")))
                .withColumn("newton", F.when(F.col("bend") > 0, F.col("step") - miss / F.col("bend"))))
        within = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        step = F.when(F.col("done"), F.col("step")).when(within & F.lit(k < NEWTON_STEPS), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = written(rows.select(*(c for c in state.columns if c not in ("step", "done")), step.alias("step"), "done"), "multipliers")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", F.when(F.col("inside"), F.col("step")).alias("lambda"))


def rates(hist: DataFrame, found: DataFrame, most: int = MOST) -> DataFrame:
    """The histogram with its source's columns and the ``rate`` of its documents."""
    named = found.withColumnRenamed("source", "source_")
    rows = hist.join(named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    flat = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(float(most))
    return rows.withColumn("rate", F.when(F.col("lambda").isNull() | (F.col("size") == 0), flat)
                           .otherwise(_tilted("lambda", most)[0]))


ROUNDED = "source string, size bigint, source_size bigint, target double, rate double, whole bigint, extra bigint"


def _copies(sizes: list[int], counts: list[int], rates: list[float], most: int = MOST) -> list[int]:
    """Copies that the documents of each size of one source take together, largest size first.

    What rounding owes or has given too much goes on to the next size.  A second walk settles the rest where
    documents can still take the other of the two whole numbers around their rate, and a third, of use
    to sources of a few documents only, anywhere up to the bound.
    """
    floors = [math.floor(r + 1e-12) for r in rates]
    parts = [max(0.0, r - f) for r, f in zip(rates, floors)]
    tilted = [k for k, (size, part) in enumerate(zip(sizes, parts)) if size and part]
    out, owed = [f * n for f, n in zip(floors, counts)], 0.0
    for walk in range(3):
        for k in tilted:
            n, size = counts[k], sizes[k]
            low, high = (0, most * n) if walk == 2 else (floors[k] * n, (floors[k] + 1) * n)
            if walk == 0:
                owed += parts[k] * n * size
            more = min(high, max(low, out[k] + math.floor(owed / size + 0.5))) - out[k]
            owed -= more * size
            out[k] += more
    return out


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by source and falling size; holds one source's sizes at a time."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("source", "size", "n", "source_size", "target", "rate"))):
            if held and row[0] != key:
                yield _finished(held)
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield _finished(held)


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    source, size, n, source_size, target, rate = map(list, zip(*rows))
    total = _copies(size, n, rate)
    return pa.RecordBatch.from_arrays(
        [pa.array(source, pa.string()), pa.array(size, pa.int64()), pa.array(source_size, pa.int64()), pa.array(target, pa.float64()),
         pa.array(rate, pa.float64()), pa.array([t // k for t, k in zip(total, n)], pa.int64()), pa.array([t % k for t, k in zip(total, n)], pa.int64())],
        names=["source", "size", "source_size", "target", "rate", "whole", "extra"])


def rounded(rated: DataFrame) -> DataFrame:
    """Copies of every document of a (source, size), and the number of those that get one more."""
    rows = rated.select("source", "size", "n", "source_size", "target", "rate")
    return written(rows.repartition("source").sortWithinPartitions("source", F.col("size").desc()).mapInArrow(_rounded, ROUNDED), "rounded")


def mixed(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, columns: list[str] | None = None) -> DataFrame:
    """The documents (all columns, or those named) under ``doc_`` with size, source_size, target, rate and copies."""
    spark = documents.sparkSession
    rows = written(sized(documents, columns), "sized")
    hist = histogram(rows)
    copies = rounded(rates(hist, multipliers(hist, targets(hist, weights, most), most), most))
    # places of the documents inside (source, size): one sort over all tasks, then the counts of its parts
    order = ["source", "size", "id_", "spread"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("spread", "id_")
    placed = written(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "placed")
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("source", "size", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    starts = starts.select("source", "size", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    here = [F.col(c).alias(f"{c}_") for c in ("source", "size")]
    starts = starts.join(copies.select(*here, "source_size", "target", "rate", "whole", "extra"),
                         F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_"))).drop("source_", "size_")
    starts = starts.select(*here, F.col("part").alias("part_"), "first", "earlier", "source_size", "target", "rate", "whole", "extra")
    out = placed.join(starts, (F.col("part") == F.col("part_")) & (F.col("size") == F.col("size_")) & F.col("source").eqNullSafe(F.col("source_")))
    one_more = F.col("at") - F.col("first") + F.col("earlier") < F.col("extra")
    return out.select("doc_", "size", "source_size", "target", "rate", (F.col("whole") + one_more.cast("long")).alias("copies"))


def mixture(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    out = mixed(documents, weights, most).where("copies > 0")
    return out.select("doc_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_.*")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs, columns=["doc_id"]).select("doc_.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
