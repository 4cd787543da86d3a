"""The pipeline's stages on the smallest tables: each works on what the one before it kept."""

import re

import corpus_pipeline
from routewise.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tiny, tmp_path):
    from tests.llm.test_brute_force import plain_spans
    from tests.llm.test_near_stage import plain_components
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r["doc_id"]: r["text"] or "" for r in docs.collect()}]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns, name
            rows = docs.collect()
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
            seen.append({r["doc_id"]: r["text"] for r in rows})
    start, good, lines, single, private = seen
    quality = dict(tiny.execute("select doc_id, quality from labels").fetchall())
    assert all(start[d] == t for d, t in good.items())
    assert sum((d in good) == bool(q) for d, q in quality.items()) >= 0.95 * len(quality)
    first, want = set(), {}
    for d in sorted(good):
        rows = good[d].split("\n")
        at = [i for i, x in enumerate(rows) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for i in range(len(at) - 2):
            window = tuple(rows[j] for j in at[i:i + 3])
            if window in first:
                gone |= set(at[i:i + 3])
            first.add(window)
        text = "\n".join(x for i, x in enumerate(rows) if i not in gone)
        if not gone or text.strip(" \t\n\x0b\x0c\r"):
            want[d] = text
    assert lines == want
    comp = plain_components(lines, corpus_pipeline.NEAR_PERCENT)
    assert single == {d: t for d, t in lines.items() if comp[d] == d}
    assert set(private) == set(single)
    for d, t in single.items():
        assert (private[d] != t) if plain_spans(t) else (private[d] == t or "IBAN]" in private[d] or "SSN]" in private[d])
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(private) and all(r["length"] <= packing.LENGTH for r in packed)


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
