"""The recall audit of the graph search, and shards that grow with a label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewise.llm import embedding_dedup as op
from routewise.llm.hnsw import Hnsw


def pairs_and_singles(n_pairs=300, n=2500, dim=32, seed=2):
    """Unit vectors of which few have exactly one near partner."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n - n_pairs:] = x[:n_pairs] + rng.normal(size=(n_pairs, dim)) * 0.05
    return op.unit(x)


def plain_links(x, cosine=op.COSINE):
    true = x @ x.T >= cosine
    np.fill_diagonal(true, False)
    return [np.flatnonzero(r) for r in true]


def test_graph_finds_the_links():
    x = pairs_and_singles()
    found, width = op.audited(Hnsw.build(x), x, x, np.arange(len(x)), op.COSINE)
    want = plain_links(x)
    assert sum(map(len, want)) >= 600
    assert np.mean([len(np.intersect1d(f, w)) / len(w) for f, w in zip(found, want) if len(w)]) >= 0.99
    assert all(np.isin(f, w).all() for f, w in zip(found, want)) and width == op.BEAM


@pytest.mark.parametrize("hidden", [0.1, 0.3, 1.0])
def test_hidden_links_widen_the_beam(hidden):
    """Nodes that no link leads to: whatever their share of the pairs, the audit sees it and the search goes on."""
    x = pairs_and_singles()
    graph = Hnsw.build(x)
    lost = np.arange(int(300 * hidden))
    for links in graph.links:
        links[np.isin(links, lost)] = -1
    graph.entry = 1000
    found, width = op.audited(graph, x, x, np.arange(len(x)), op.COSINE)
    want = plain_links(x)
    assert width > op.BEAM
    assert np.mean([len(np.intersect1d(f, w)) / len(w) for f, w in zip(found, want) if len(w)]) >= 0.98


def test_audit_leaves_out_matches_with_oneself_and_counts_queries_alike():
    x = pairs_and_singles()
    want = plain_links(x)
    own = np.arange(len(x))
    assert op.recall(want, own, x, x, op.COSINE) == 1.0
    nothing = [np.zeros(0, int)] * len(x)
    assert op.recall(nothing, own, x, x, op.COSINE) == 0.0
    half = [w if i % 2 else w[:0] for i, w in enumerate(want)]
    assert 0.3 < op.recall(half, own, x, x, op.COSINE) < 0.7
    group = op.unit(np.concatenate([np.ones((500, 32)) + np.random.default_rng(0).normal(size=(500, 32)) * 0.01, x]))
    true = plain_links(group)
    only_group = [w if i < 500 else w[:0] for i, w in enumerate(true)]
    assert op.recall(only_group, np.arange(len(group)), group, group, op.COSINE) < 0.9


def test_many_shards_and_blocks_give_all_links(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD", 300)
    monkeypatch.setattr(op, "SHARDS", 4)
    monkeypatch.setattr(op, "QUERIES", 100)
    x = pairs_and_singles(100, 1500, 16)
    df = spark.createDataFrame([(i, v.tolist(), 7) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in op.near_duplicates(df).collect()}
    assert got == {i: len(w) for i, w in enumerate(plain_links(x))}
    assert op.near_duplicates(df.withColumn("label", F.lit(None).cast("int"))).where("n_links > 0").count() == 0
