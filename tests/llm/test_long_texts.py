"""Personal data and line dedup on very long texts, against plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from routewise.llm import line_dedup, pii

KINDS = list(pii.PATTERNS)


def plain_redact(text, spans):
    """Spans (kind, start, end) replaced; those that overlap become one, named by the first."""
    merged = []
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out.append(text[at:start] + f"[{kind.upper()}]")
        at = end
    return "".join(out) + text[at:]


def test_many_addresses_in_one_text(spark):
    """A mailing list of 20,000 addresses among astral characters: places and redaction, in time that follows the length."""
    random.seed(1)
    parts, spans, at = [], [], 0
    for i in range(20_000):
        gap = random.choice([" ", ", ", "\n", " ünd 😀 ", " x " * 9, " " * 700 if i % 500 == 0 else " "])
        hit = f"name{i}@host{i % 7}.example.org"
        parts += [gap, hit]
        spans.append(("email", at + len(gap), at + len(gap) + len(hit)))
        at += len(gap) + len(hit)
    text = "".join(parts) + " the end 😀"
    df = spark.createDataFrame([(1, text), (2, text[:5000])], "doc_id long, text string")
    start = time.time()
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.with_spans(df, "text", "spans").collect()}
    assert found[1] == spans
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got[1] == plain_redact(text, spans)
    assert got[2] == plain_redact(text[:5000], found[2])
    assert time.time() - start < 120


def test_redaction_of_mixed_and_overlapping_spans(spark, tiny):
    """Whole table: the redacted text is what the spans say, over every kind and across segments and chunks."""
    texts = {d: t or "" for d, t in tiny.execute("select doc_id, text from documents").fetchall()}
    base = "call +49 (30) 123-45-67 or a.b@c.de, host 10.0.0.1; card 4111 1111 1111 1111; iban DE89370400440532013000; ssn 123-45-6789; "
    texts |= {-1: base * 50, -2: "1.2.3.4@5.6.7.8 +1.2.3.4.5.6.7.8.9 " * 200, -3: "é" * 1023 + "a@b.co" + "😀" * 1018 + "c@d.eu", -4: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["s"]] for r in pii.with_spans(df, "text", "s").collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {d: plain_redact(t, spans[d]) for d, t in texts.items()}
    assert sum(map(bool, spans.values())) >= 10 and {k for v in spans.values() for k, _, _ in v} == set(KINDS)


def test_context_is_looked_up_where_the_match_stands(spark):
    """The words around an ssn decide, also where they cross a segment's border."""
    size = pii.SEGMENT
    rows = [(i, "x" * (size - 12 + i) + " ssn is " + "123-45-6789" + " yes") for i in range(24)]
    rows += [(100 + i, "x" * (size - 12 + i) + " no word " + "123-45-6789" + " at all") for i in range(24)]
    rows += [(200, "123-45-6789 " + "y" * 30 + " ssn"), (201, "123-45-6789 the ssn")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: len(r["s"]) for r in pii.with_spans(df, "text", "s").collect()}
    assert got == {d: int(d < 24 or d == 201) for d, _ in rows}


def test_a_text_of_many_lines(spark):
    """100,000 lines that repeat another text's: all covered lines go, the others stay in place."""
    lines = [f"line number {i}" for i in range(100_000)]
    extra = [x for i, line in enumerate(lines) for x in ([line] if i % 1000 else ["", f"own {i}", line])]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(extra))], "doc_id long, text string")
    start = time.time()
    got = {r["doc_"]["doc_id"]: r["doc_"]["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got[1] == "\n".join(lines)
    want = [x for x in extra if re.match("own|$", x)]
    assert got[2] == "\n".join(want)
    assert time.time() - start < 120
    assert line_dedup.dedup_lines(df.withColumn("text", F.lit(None).cast("string"))).where("doc_.text is not null").count() == 0
