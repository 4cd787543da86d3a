"""Shards over overfull ranges, many pieces and groups of equal rows."""

import pytest

from routewise.llm import sharding


def check(rows, n_shards, documents):
    assert len(rows) == documents
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(n_shards):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / n_shards) < 2 * most


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_a_group_of_copies_of_a_third_of_all_rows(spark, monkeypatch, range_rows):
    """One text under many ids and without any id, in ranges of few rows and of many."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", range_rows)
    rows = [(i, f"text {i} " + "word " * (i % 50)) for i in range(3000)]
    rows += [(10_000 + i, "the same text") for i in range(900)] + [(None, "the same text")] * 700 + [(5, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sharding.shard_documents(df, 6)
    check(placed.collect(), 6, len(rows))
    again = sharding.shard_documents(df, 6)
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, placed.collect())) == sorted(map(key, again.collect()))


def test_one_text_only(spark):
    df = spark.createDataFrame([(None, "x")] * 500, "doc_id long, text string")
    check(sharding.shard_documents(df, 24).collect(), 24, 500)
