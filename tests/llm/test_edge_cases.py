"""Each operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

from pyspark.sql import functions as F

from routewise.llm import (embedding_dedup, line_dedup, minhash_dedup, packing, pieces, pii, quality_classifier,
                           quality_rules, sharding, toxicity)


def by_id(df):
    return {r["doc_id"]: r for r in df.where("doc_id is not null").collect()}


def test_sharding(odd, nothing):
    rows = sharding.shard_documents(odd, 4).collect()
    assert len(rows) == odd.count()
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}
    assert sharding.shard_documents(nothing).count() == 0


def test_sharding_writes_all_rows(odd, spark, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


def test_minhash(odd, nothing):
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: r for r in rows}
    assert [found[d]["n_shingles"] for d in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert found[10]["component_id"] == 4 and not found[10]["kept"]  # equal short texts
    assert found[7]["component_id"] == 6 and found[2]["component_id"] == 2
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert minhash_dedup.near_duplicates(nothing).count() == 0
    kept = minhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 8, 9, 11, 12]
    assert minhash_dedup.keep_one(nothing).count() == 0


def test_pii(odd, nothing):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    found = by_id(out)
    assert found[9]["text"] == "Ünïcode ß 日本 😀 [EMAIL]" and found[1]["text"] is None and found[2]["text"] == ""
    assert pii.redact(nothing).count() == 0


def test_quality_classifier(odd, nothing, spark):
    labels = spark.createDataFrame([(12, 1, 0), (8, 0, 0), (5, 0, 0), (None, 1, 0), (6, None, None), (12, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        model = quality_classifier.fit(odd, labelled)
        rows = odd.select("doc_id", quality_classifier.score_column(spark, model).alias("p")).collect()
        assert len(rows) == odd.count() and all(0 <= r["p"] <= 1 for r in rows)
        assert len({r["p"] for r in rows if r["doc_id"] in (1, 2)}) == 1
        assert nothing.select(quality_classifier.score_column(spark, model)).count() == 0


def test_quality_rules(odd, nothing):
    found = by_id(quality_rules.verdicts(odd))
    assert [found[d]["n_words"] for d in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert found[5]["n_repeat_words"] == 30_000 and found[5]["base_failed"] and not found[5]["kept"]
    assert not found[12]["base_failed"]
    assert quality_rules.verdicts(nothing).count() == 0


def test_line_dedup(odd, nothing):
    out = line_dedup.dedup_lines(odd)
    found = {r["doc_"]["doc_id"]: r for r in out.collect()}
    assert found[1]["doc_"]["text"] is None and found[1]["n_lines"] == 0
    assert found[6]["n_removed"] == 0 and found[7]["n_removed"] == 4
    assert found[11]["doc_"]["text"] == "last line here"
    cleaned = line_dedup.clean(odd)
    assert cleaned.columns == odd.columns and 7 not in by_id(cleaned)
    assert line_dedup.clean(nothing).count() == 0


def test_packing(odd, nothing):
    rows = packing.pack_documents(odd).collect()
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert packing.pack_documents(nothing).count() == 0
    assert packing.sequences(odd).count() == len(by_sequence)


def test_sentencepiece(odd, nothing):
    back = pieces.decoded(pieces.encoded(odd)).collect()
    texts = sorted(t or "" for (t,) in odd.select("text").collect())
    assert sorted(r["text"] for r in back) == texts
    assert {r["n_ids"] for r in back if r["doc_id"] in (1, 2)} == {0}
    assert pieces.encoded(nothing).count() == 0


def test_toxicity(odd, nothing, spark):
    labels = spark.createDataFrame([(12, 1, 0), (8, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        lexicon = toxicity.fit(odd, labelled)
        rows = odd.select("doc_id", toxicity.score_column(spark, lexicon).alias("p")).collect()
        assert len(rows) == odd.count() and all(0 <= r["p"] <= 1 for r in rows)
        assert nothing.select(toxicity.score_column(spark, lexicon)).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.01], 0), (4, [1.0, 0.0], 1),
            (5, [1.0, 0.0], None), (6, None, 0), (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0),
            (10, [None, 1.0], 0), (None, [1.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [], 0), (13, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("extra"))
    out = embedding_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    found = {r["vec_id"]: r for r in out}
    assert [found[v]["n_links"] for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)] == [3, 3, 3] + [0] * 10
    assert found[3]["component_id"] == 1 and not found[3]["kept"] and found[13]["kept"] and found[None]["n_links"] == 0
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
