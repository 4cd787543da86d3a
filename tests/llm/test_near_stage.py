"""The pipeline's near-duplicate stage against plain Python at its own similarity of 0.80."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from routewise.llm import minhash_dedup
from tests.llm.test_brute_force import components

SF = "/root/testdata/sf0.001"


def plain_components(texts, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(d for d in sets if sets[d])
    return components(sets, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
                             if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])


def test_stage_takes_similarity_of_80(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    comp = plain_components(texts, 80)
    assert comp != plain_components(texts, 85)  # the table holds pairs between the two
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert kept == {d for d in texts if comp[d] == d}


def test_percent_is_a_parameter_and_85_stays_the_default(spark, monkeypatch):
    """Pairs at 0.82, in small buckets and in blocks."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 2)
    base = [f"w{i}" for i in range(404)]
    texts = {d: " ".join([*base[:-9 * 4], *(f"x{d}y{i}" for i in range(36))]) for d in range(6)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for percent in (80, 85):
        comp = plain_components(texts, percent)
        found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, percent).collect()}
        assert found == comp and len(set(comp.values())) == (1 if percent == 80 else 6)
    assert {r["component_id"] for r in minhash_dedup.near_duplicates(df).collect()} == set(texts)


def test_different_texts_under_one_id_are_judged_apart(spark):
    """Of two texts under one id one repeats an earlier document, the other is like nothing else."""
    first, second, third = (" ".join(f"{c}{i}" for i in range(200)) for c in "xyz")
    rows = [(1, first), (2, first + " end"), (2, second), (2, second), (3, third), (3, None), (4, third), (None, first), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1_", F.lit("extra"))
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, first), (2, second), (3, third), (3, None), (0, first), (5, "")], key=repr)
