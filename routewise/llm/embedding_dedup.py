"""Near-duplicate embeddings: a navigable small-world graph per shard, every shard queried.

Equal vectors of a label are one class with a count.  The classes of a label (and vector length) are
dealt by a hash into shards, each indexed by a graph that is written to the shared folder.  Shards grow with
the label up to what a task's memory holds, so their number, and with it the work, hardly does.  Every class
queries every shard of its label, in blocks.  A query keeps all it meets of at least the asked similarity, however
many.  In each task an audit draws queries at random, without looking at what they found, and compares them with
brute force over the shard until AUDIT of them have a true link to another vector, or all are drawn.  The mean
share of a query's links that was found must reach ``AUDIT_RECALL``, so that queries with one link count as much as
those with thousands; until then beams and starting points grow and all queries of the task run again (once
every vector is a starting point, a beam misses nothing).
Found pairs are verified in double precision.  A task gives, per query, the number of vectors linked and
its root in a local union of the found links, so pairs inside a group are never listed; components of
those rows follow.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without a label, link with nothing and are their own component; a null vec_id links with nothing, has no
component and is kept; equal vectors and repeated rows link with each other; vectors of different
lengths do not compare; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import written
from routewise.llm.components import components
from routewise.llm.hnsw import Hnsw
from routewise.sources.tables import read_table

COSINE = 0.93
#: A label has one shard up to SHARD vectors, then at most SHARDS, until a shard's vectors fill SHARD_BYTES.
SHARD, SHARDS, SHARD_BYTES = 8192, 16, 1 << 26
#: Blocks of queries have at least QUERIES vectors, and a quarter of a shard's.
QUERIES = 2048
BEAM = 24
#: Queries with links that an audit compares at least, the recall it asks for, and the queries it compares at a time.
AUDIT, AUDIT_RECALL, AUDIT_STEP = 128, 0.99, 256
#: Below the limit by which single precision may misjudge a pair; verified in double precision afterwards.
SLACK = 1e-4


def unit(vectors) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard, with its members' ids, counts and vectors."""
    rows = rows.sort_values("node")
    x = unit(rows["embedding"])
    return pd.DataFrame({
        "label": rows["label"].iloc[:1], "dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1],
        "n_blocks": rows["n_blocks"].iloc[:1], "graph": [Hnsw.build(x).to_bytes()], "nodes": [rows["node"].to_numpy(np.int64).tobytes()],
        "counts": [rows["copies"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})


def recall(found: list[np.ndarray], own: np.ndarray, x: np.ndarray, queries: np.ndarray, cosine: float) -> float:
    """Mean share of its links that a query found, over random queries with links; ``own`` is a query's place in x, or -1."""
    order = np.random.default_rng(1).permutation(len(queries))
    shares: list[float] = []
    for at in range(0, len(order), AUDIT_STEP):
        sample = order[at:at + AUDIT_STEP]
        true = queries[sample] @ x.T >= cosine
        inside = np.flatnonzero(own[sample] >= 0)
        true[inside, own[sample][inside]] = False
        for row, i in zip(true, sample.tolist()):
            if n := np.count_nonzero(row):
                shares.append(np.count_nonzero(row[found[i]]) / n)
        if len(shares) >= AUDIT:
            break
    return float(np.mean(shares)) if shares else 1.0


def audited(graph: Hnsw, x: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float) -> tuple[list[np.ndarray], int]:
    """Members other than itself of at least ``cosine`` for each query, and the beam's width that passed the audit."""
    width, starts, n = BEAM, 1, len(x)
    while True:
        found = []
        for i, (ids, exact) in enumerate(zip(graph.search(queries, width, cosine - SLACK, starts), queries)):
            ids = ids[ids != own[i]]
            found.append(ids[x[ids] @ exact >= cosine])
        if starts >= n or recall(found, own, x, queries, cosine) >= AUDIT_RECALL:
            return found, width
        width, starts = min(2 * width, n), min(8 * starts, n)


def query_block(key, graphs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """node, number of vectors linked in this shard, and root of each query and of each member linked."""
    out = {"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}
    if not len(graphs) or not len(rows):
        return pd.DataFrame(out)
    g = graphs.iloc[0]
    members, counts = np.frombuffer(g["nodes"], np.int64), np.frombuffer(g["counts"], np.int64)
    x = np.frombuffer(g["vectors"], np.float64).reshape(len(members), -1)
    nodes = rows["node"].to_numpy(np.int64)
    place = np.minimum(np.searchsorted(members, nodes), len(members) - 1)
    own = np.where(members[place] == nodes, place, -1)
    found, _ = audited(Hnsw.from_bytes(g["graph"]), x, unit(rows["embedding"]), own, COSINE)
    everyone = np.unique(np.concatenate([members, nodes]))
    of_member, of_query = np.searchsorted(everyone, members), np.searchsorted(everyone, nodes)
    root, changed = np.arange(len(everyone)), True
    pairs = [(q, of_member[f]) for q, f in zip(of_query.tolist(), found) if len(f)]
    while changed:
        changed = False
        for q, f in pairs:
            least = min(root[q], root[f].min())
            if root[q] != least or (root[f] != least).any():
                root[q] = least
                root[f] = least
                changed = True
    also = np.setdiff1d(np.flatnonzero(root != np.arange(len(everyone))), of_query)
    out["node"] = np.concatenate([nodes, everyone[also]])
    out["links"] = np.concatenate([[counts[f].sum() for f in found], np.zeros(len(also))]).astype(np.int64)
    out["root"] = everyone[root[np.concatenate([of_query, also])]]
    return pd.DataFrame(out)


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    e = F.col("embedding")
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0)
            & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    plain = F.transform(e, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double")))  # -0.0 equals 0.0
    key = F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit(1), plain).alias("b"))
    rows = rows.withColumn("key", F.when(F.col("good"), key))
    firsts = (rows.where("good").groupBy("label", "key", F.size("embedding").alias("dim"))
              .agg(F.min(F.struct("vec_id", "embedding")).alias("first"), F.count("*").alias("copies")))
    classes = written(firsts.select("label", "key", "dim", F.col("first.vec_id").alias("node"),
                                    F.col("first.embedding").alias("embedding"), "copies"), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))))
    shard = F.least(F.greatest(F.lit(SHARD), F.ceil(F.col("n") / SHARDS)), most)
    sizes = sizes.select("label", "dim", F.ceil(F.col("n") / shard).cast("int").alias("n_shards"),
                         F.ceil(F.col("n") / F.greatest(F.lit(QUERIES), F.floor(shard / 4))).cast("int").alias("n_blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumns({
        "shard": F.pmod(F.xxhash64("node", F.lit(1)), "n_shards").cast("int"),
        "block": F.pmod(F.xxhash64("node", F.lit(2)), "n_blocks").cast("int")})
    kind = classes.schema["label"].dataType.simpleString()
    graphs = written(dealt.select("label", "dim", "shard", "n_blocks", "node", "embedding", "copies")
                     .groupBy("label", "dim", "shard").applyInPandas(
        build_shard, f"label {kind}, dim int, shard int, n_blocks int, graph binary, nodes binary, counts binary, vectors binary"), "graphs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = dealt.select("label", "dim", "block", every("n_shards").alias("shard"), "node", "embedding")
    offered = graphs.withColumn("block", every("n_blocks")).drop("n_blocks")
    on = ["label", "dim", "shard", "block"]
    found = written(offered.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(
        query_block, "node long, links long, root long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (classes.select("label", "key", "node", "copies").join(links, "node", "left").join(comps, "node", "left")
             .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("comp", "node").alias("component_id")))
    out = rows.select("vec_id", "label", "key").join(known, ["label", "key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
with recursive good as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
link as materialized (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
    and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  select vec_id, vec_id as other from embeddings
  union select r.vec_id, l.b from reach r join link l on r.other = l.a),
comp as (select vec_id, min(other) as component_id from reach group by vec_id),
n as (select a, count(*) as n from link group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join comp c on e.vec_id = c.vec_id left join n on e.vec_id = n.a
"""
