"""Quality rules: thresholds from mergeable quantile sketches per language and source.

The metrics of every whole text are written once as a narrow table.  Each (lang, source) gets one
KLL sketch per metric, over all its documents; the sketches of a language, and of all documents, come from
merging these, not from another pass.  A document is judged by the sketches of its own group, or of its
language where the group has fewer than ``MIN_GROUP`` documents, or of all documents where the language has so few.

A limit comes from the group's quantiles alone: from the edge of its bulk (the 80 % quantile) it leaves ``SPREAD`` times
the bulk's own width above the median, and ``TAIL`` of the way to its extreme (the 99.5 % quantile).  So a
metric that is 0 for nearly all of a group, as the share of symbols is, still has a limit set by that group's
outliers and by no constant, and the bulk is never cut.  The mean word length has such a lower limit as well.
The limits join the metrics on lang and source.

Defined cases: a null or empty text has no words and fails the base rules; null lang or source is a
group of its own; repeated rows and ties are judged alike; an empty table gives no rows; only doc_id,
text, lang and source are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import WordTable, chunks, per_text_sum, text_bytes, written
from routewise.sources.tables import read_table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
METRICS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_length")
TWO_SIDED = ("word_length",)
#: Groups with fewer documents are judged by their language's sketches.
MIN_GROUP, SKETCH_K = 200, 800
#: Quantiles of the median, the bulk's upper edge and the extreme (mirrored for lower limits), and what a limit leaves beyond the edge.
MEDIAN, EDGE, EXTREME = 0.5, 0.8, 0.995
SPREAD, TAIL = 3.0, 0.33
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(ids: np.ndarray, counts: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, the words in windows of ``width`` words that occur twice or more in that text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(len(counts), np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    if not len(at):
        return np.zeros(len(counts), np.int64)
    # exact numbers for (text, first word), then for each further word: no hash, so no chance match
    number, most, base = doc[at], len(counts), int(ids.max()) + 1
    for k in range(width):
        if most * base >= 1 << 62:
            number, most = np.unique(number, return_inverse=True)[1], len(at)
        number, most = number * base + ids[at + k], most * base
    _, number, found = np.unique(number, return_inverse=True, return_counts=True)
    twice = found[number] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[at[twice] + k] = True
    return per_text_sum(covered, counts).astype(np.int64)


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[bytes], table: WordTable) -> dict[str, np.ndarray]:
    """The counts of whole texts."""
    ids, counts = table.encode(texts)
    lines = [duplicate_lines(t) for t in texts]
    return {
        "n_words": counts,
        "word_chars": np.array([len(t.translate(None, SPACES).decode("utf-8", "replace")) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([d for _, d in lines], np.int64),
        "n_repeat_words": repeated_words(ids, counts),
        "n_lines": np.array([n for n, _ in lines], np.int64),
    }


def metrics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    rows = documents.select("doc_id", "lang", "source", text_bytes().alias("text"))
    kept = rows.drop("text").schema
    names = kept.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            for part, texts in chunks(batch):
                found = measure(texts, table)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                    names=[*names, *COUNTS])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, types + "".join(f", {c} bigint" for c in COUNTS))


def _ratios(df: DataFrame) -> DataFrame:
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return df.withColumns({
        "symbol_ratio": F.col("n_symbols") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
        "dup_line_ratio": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines")),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    })


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def limits(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with the limits that hold there; written, as sketches draw at random."""
    rows = _ratios(measured)
    own = rows.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in METRICS))
    own = written(own, "sketches")
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in METRICS)]

    def cut(df: DataFrame, mark: str) -> DataFrame:
        for m in METRICS:
            some = F.kll_sketch_get_n_double(F.col(m)) > 0  # an empty sketch has no quantile
            at = lambda r: F.when(some, F.kll_sketch_get_quantile_double(F.col(m), F.lit(r)))  # noqa: E731, B023
            limit = lambda mid, edge, far: edge + SPREAD * (edge - mid) + TAIL * (far - edge)
            df = df.withColumns({f"{m}_{mark}max": limit(at(MEDIAN), at(EDGE), at(EXTREME)),
                                 f"{m}_{mark}min": limit(at(MEDIAN), at(1 - EDGE), at(1 - EXTREME))})
        return df.drop(*METRICS).withColumnRenamed("n", f"{mark}n")

    by_lang = cut(own.groupBy("lang").agg(*merged), "l_").withColumnRenamed("lang", "l_lang")
    overall = cut(own.agg(*merged), "a_").first()  # one row of limits
    out = cut(own, "").join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    for m in METRICS:
        for end in ("max", "min"):
            out = out.withColumn(f"{m}_{end}", F.when(F.col("n") >= MIN_GROUP, F.col(f"{m}_{end}"))
                                 .when(F.col("l_n") >= MIN_GROUP, F.col(f"{m}_l_{end}"))
                                 .otherwise(F.lit(overall[f"{m}_a_{end}"]).cast("double")))
    ends = [f"{m}_max" for m in METRICS] + [f"{m}_min" for m in TWO_SIDED]
    return written(out.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *ends), "limits")


def verdicts(documents: DataFrame) -> DataFrame:
    """Counts, ratios, limits and verdict of each document."""
    measured = written(metrics(documents), "metrics")
    rows = _ratios(measured)
    rows = rows.join(limits(measured), F.col("lang").eqNullSafe(F.col("g_lang"))
                     & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = F.lit(True)
    for m in METRICS:
        within &= F.coalesce(F.col(m) <= F.col(f"{m}_max"), F.lit(True))
    for m in TWO_SIDED:
        within &= F.coalesce(F.col(m) >= F.col(f"{m}_min"), F.lit(True))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return verdicts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
