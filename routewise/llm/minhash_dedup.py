"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard verification, components.

A shingle is hashed to a position of a universe of 2^20.  One fixed permutation shuffles the positions;
the second one, circularly shifted by 0, 1, 2, ..., gives all signature coordinates: coordinate k of a
text is the smallest entry of the second permutation at its shuffled positions plus k.  Bands of
coordinates are bucket keys: two texts with similarity 0.85 miss each other in all bands with a chance of
about 3 in 10^6.

Texts with equal sets are one class, and only one member of a class goes on.  In each bucket every member
is compared with one centre (linear work, whatever the bucket's size); links are confirmed on the full
sets, and components are formed.  Members of a bucket that are in different components by then still
have to be compared: in a bucket of at most ``SMALL`` members as pairs, in a larger one as blocks of at
most about ``BLOCK`` members, each task comparing one block of members outside the bucket's largest
component with one block of all.  A block task gives at most one link per pair of components.  So no link
between different components is lost, and pairs inside a component are never listed.

Defined cases: a null or empty text, or one without words, has no shingles and is its own component;
texts under five words are one shingle; a null doc_id links with nothing, has no component and is kept;
rows with one doc_id and different texts are told apart by their texts, unless that id is the smallest
of both, which makes them one document; an empty table gives no rows; extra columns are never read, and
pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import WordTable, chunks, text_bytes, worker_kept, written
from routewise.llm.components import components
from routewise.sources.tables import read_table

WIDTH = 5
PERCENT = 85
UNIVERSE = 1 << 20
ROWS, BANDS = 8, 40
SMALL, BLOCK = 32, 256
SEED = 11
#: Shingles, and columns of a block's incidence matrix, handled at a time.
STEP, COLUMNS = 512, 1 << 14


class Shingler:
    """Sets of hashed word shingles of whole texts."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.reset()
        self.table = WordTable(self.derive, self.reset)

    def reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)

    def derive(self, words: list[bytes]) -> None:
        new = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.hashes = np.concatenate([self.hashes, new])

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct 64-bit shingle hashes of each text; bytes.lower() lower-cases A-Z alone."""
        ids, counts = self.table.encode([t.lower() for t in texts])
        words = self.hashes[ids]
        out, at = [], 0
        for n in counts.tolist():
            own = words[at:at + n]
            at += n
            size = min(n, self.width)
            if not size:
                out.append(own[:0])
                continue
            mixed = np.full(n - size + 1, size, np.uint64)
            for k in range(size):
                mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ own[k:n - size + 1 + k]
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
            out.append(np.unique(mixed))
        return out


class Circulant:
    """Signatures from two permutations, the second circularly shifted once per coordinate."""

    def __init__(self, size: int = ROWS * BANDS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.first = rng.permutation(UNIVERSE)
        second = rng.permutation(UNIVERSE).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:size - 1]]), size)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        out = self.shifted[at[:STEP]].min(0)
        for i in range(STEP, len(at), STEP):
            np.minimum(out, self.shifted[at[i:i + STEP]].min(0), out=out)
        return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key per signature and band."""
    parts = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        keys = (keys ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def fingerprints(documents: DataFrame, per_band: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and bucket keys of each document."""
    rows = documents.select("doc_id", text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, circulant = worker_kept(("shingler", per_band * bands), lambda: (Shingler(), Circulant(per_band * bands)))
        for batch in batches:
            for part, texts in chunks(batch):
                sets = shingler.sets(texts)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(np.stack([circulant.signature(s) for s in full]), per_band).tolist() if full else [])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "buckets"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, buckets array<long>")


def shingle_sets(documents: DataFrame) -> DataFrame:
    """node and its set, as sorted little-endian 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, _ = worker_kept(("shingler",), lambda: (Shingler(), Circulant()))
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([s.tobytes() for s in shingler.sets(texts)], pa.binary())],
                    names=["node", "set"])

    return documents.mapInArrow(run, "node long, set binary")


def _linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def is_link(a: pa.Array, b: pa.Array, percent: int) -> pa.Array:
    """Whether two full sets are as similar as asked."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        if not len(x) or 100 * len(x) < percent * len(y):
            out.append(False)
            continue
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out.append(bool(_linked(int((y[at] == x).sum()), len(x), len(y), percent)))
    return pa.array(out, pa.bool_())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    size = F.octet_length
    near = (100 * size("set_a") >= percent * size("set_b")) & (100 * size("set_b") >= percent * size("set_a"))

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        return is_link(a, b, percent)

    return (pairs.join(one, "a").join(two, "b").where(near)
            .where(linked("set_a", "set_b")).select("a", "b"))


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between members in one component and members in another, one per pair of components at most."""
    sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
    size = np.array([len(s) for s in sets], np.int64)
    outside = np.flatnonzero(rows["outside"].to_numpy())
    inside = np.flatnonzero(~rows["outside"].to_numpy())
    shingles, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((len(outside), len(inside)), np.float64)
    for start in range(0, len(shingles), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, len(shingles) - start)), np.float32)
        held[row[lo:hi], column[lo:hi] - start] = 1
        inter += held[outside] @ held[inside].T
    comp, node = rows["comp"].to_numpy(), rows["node"].to_numpy()
    a, b = np.nonzero(_linked(inter, size[outside][:, None], size[inside][None, :], percent)
                      & (comp[outside][:, None] != comp[inside][None, :]))
    a, b = outside[a], inside[b]
    found = pd.DataFrame({"a": node[a], "b": node[b], "x": np.minimum(comp[a], comp[b]), "y": np.maximum(comp[a], comp[b])})
    return found.drop_duplicates(["x", "y"])[["a", "b"]]


def _block(col: str, n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.greatest(F.lit(1), F.ceil(n / BLOCK))).cast("int")


def links(documents: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all linked nodes, from the written memberships (bucket, node)."""
    order = F.struct(F.xxhash64("bucket", "node"), "node")
    shared = (members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(order)["node"].alias("centre"))
              .where(F.col("n") > 1))
    members = written(members.join(shared, "bucket"), "members")
    nodes = members.select("node").distinct()
    texts = documents.select(F.col("doc_id").alias("node"), text_bytes().alias("text"))
    texts = texts.join(nodes, "node", "left_semi").dropDuplicates(["node", "text"])
    sets = written(shingle_sets(texts), "sets")

    star = members.where("node <> centre").select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    first = written(confirmed(star, sets, percent), "links")

    comps = components(first)
    rows = (members.where("n > 2").join(comps, "node", "left")
            .withColumn("comp", F.coalesce("comp", "node")))
    open_ = (rows.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
             .groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("largest"))
             .where("comps > 1").select("bucket", F.col("largest.comp").alias("major"), F.col("largest.k").alias("n_major")))
    rows = written(rows.join(written(open_, "buckets"), "bucket"), "open")  # written, so that a hot bucket can be split

    small = rows.where(F.col("n") <= SMALL)
    other = small.select("bucket", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    pairs = (small.select("bucket", F.col("node").alias("a"), F.col("comp").alias("comp_a"), "centre").join(other, "bucket")
             .where("a < b and comp_a <> comp_b and a <> centre and b <> centre").select("a", "b").distinct())
    second = confirmed(pairs, sets, percent)

    large = rows.where(F.col("n") > SMALL)
    n_out = F.col("n") - F.col("n_major")
    outside = (large.where("comp <> major").withColumn("i", _block("node", n_out, 3))
               .withColumn("j", F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)) - 1).cast("int"))))
               .withColumn("outside", F.lit(True)))
    inside = (large.withColumn("j", _block("node", F.col("n"), 4))
              .withColumn("i", F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(n_out / BLOCK)) - 1).cast("int"))))
              .withColumn("outside", F.lit(False)))
    cols = ["bucket", "i", "j", "node", "comp", "outside"]
    third = (outside.select(*cols).unionByName(inside.select(*cols)).join(sets, "node")
             .groupBy("bucket", "i", "j").applyInPandas(lambda rows: block_links(rows, percent), "a long, b long"))
    return first.unionByName(second).unionByName(third)


def near_duplicates(documents: DataFrame, percent: int = PERCENT, per_band: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document; links have a similarity of ``percent`` / 100 at least.

    Two texts of similarity s miss each other in all bands with a chance of about (1 - s ** per_band) ** bands.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(fingerprints(documents, per_band, bands), "fingerprints")
    named = prints.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    firsts = named.select("digest", F.col("doc_id").alias("node"), "buckets").join(classes, ["digest", "node"])
    members = written(firsts.select(F.explode("buckets").alias("bucket"), "node").distinct(), "buckets")
    comps = components(links(documents, members, percent))
    found = classes.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("component_id"))
    out = prints.join(found, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, percent: int = PERCENT, per_band: int = ROWS, bands: int = BANDS) -> DataFrame:
    """The documents without those that near-duplicate one before them; equal rows stay once.

    Documents are told apart by id and text and come in that order, so of different texts under one id each is judged
    by itself.  Those without an id stay.
    """
    id_, h1, h2 = documents["doc_id"].cast("long").alias("id_"), F.xxhash64("text").alias("h1_"), F.xxhash64(F.lit(1), "text").alias("h2_")
    named = documents.where(F.col("doc_id").isNotNull())
    keys = named.select(id_, h1, h2)
    clash = keys.groupBy("id_").agg(F.min(F.struct("h1_", "h2_")).alias("a"), F.max(F.struct("h1_", "h2_")).alias("b")).where("a <> b")
    if clash.isEmpty():
        verdict = near_duplicates(documents, percent, per_band, bands)
        gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id_")).distinct()
        rows = named.join(gone, documents["doc_id"].cast("long") == gone["gone_id_"], "left_anti").dropDuplicates(["doc_id"])
        return rows.unionByName(documents.where(F.col("doc_id").isNull()))
    # numbers in the order of id and text stand for the ids
    key = ["id_", "h1_", "h2_"]
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.distinct().repartitionByRange(parts, *key).sortWithinPartitions(*key)
    keys = written(keys.withColumn("node_", F.monotonically_increasing_id()), "keys")
    texts = named.select(id_, h1, h2, "text").join(keys, key).select(F.col("node_").alias("doc_id"), "text")
    stay = near_duplicates(texts, percent, per_band, bands).where("kept").select(F.col("doc_id").alias("node_")).distinct()
    stay = keys.join(stay, "node_", "left_semi").drop("node_")
    rows = named.select(F.struct(*documents.columns).alias("doc_"), id_, h1, h2).join(stay, key, "left_semi").dropDuplicates(key)
    return rows.select("doc_.*").select(*documents.columns).unionByName(documents.where(F.col("doc_id").isNull()))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: Exact similarity over all pairs that share a shingle, and components by a recursive search.
OP2_SQL = r"""
with recursive word as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
doc as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from word),
shingle as (select doc_id, len(s) as n, unnest(s) as x from doc),
shared as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as k
  from shingle a join shingle b on a.x = b.x and a.doc_id <> b.doc_id and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
  group by all),
link as materialized (select a, b from shared where 100 * k >= 85 * (na + nb - k)),
reach as (
  select doc_id, doc_id as other from doc
  union select r.doc_id, l.b from reach r join link l on r.other = l.a)
select d.doc_id, cast(len(any_value(d.s)) as bigint) as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from doc d join reach r on d.doc_id = r.doc_id group by d.doc_id
"""
