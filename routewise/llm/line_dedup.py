"""Line dedup over overlapping windows of three lines, in DataFrame expressions only.

Three consecutive lines with a word (lines without one are skipped, and always stay) make a window, so
windows overlap.  Windows are compared by two 64-bit hashes of each of their lines.  Of a window found
more than once in all texts the first occurrence, by (doc_id, text hash, line), stays; every line that a
later occurrence covers goes, and the remaining lines are joined again.

The windows are written once as a narrow table.  Their counts and first places come from a grouping that
aggregates before its shuffle; the join back to the windows has one row per repeated window on its small
side, so a very frequent window can be split over tasks.

Defined cases: a null text stays null and has no lines; a text with fewer than three lines with a word
has no window and stays whole; windows that overlap inside one text (a line repeated four times) count
as occurrences of their own; fully equal rows are one document and get the same result; a null doc_id
is the smallest; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import NO_ID, written
from routewise.sources.tables import read_table

WIDTH = 3
WORD = r"[^\x20\x09-\x0D]"


def _keys(documents: DataFrame) -> tuple[Column, Column]:
    """What names a document: its id and its text's hash."""
    return F.coalesce(documents["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(documents["text"])


def windows(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """k1, k2, h1, h2 and the line numbers (from 0) of every window."""
    k1, k2 = _keys(documents)
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(WORD).alias("word")))
    lines = F.transform(F.filter(lines, lambda x: x["word"]), lambda x: F.struct(x["i"], x["a"], x["b"]))
    df = documents.select(k1.alias("k1"), k2.alias("k2"), lines.alias("lines")).where(F.size("lines") >= width)
    line = lambda k: F.element_at("lines", F.col("at") + k + 1)
    df = df.select("k1", "k2", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - width)).alias("at"))
    return df.select("k1", "k2", F.xxhash64(*(line(k)["a"] for k in range(width))).alias("h1"),
                     F.xxhash64(*(line(k)["b"] for k in range(width))).alias("h2"),
                     F.array(*(line(k)["i"] for k in range(width))).alias("at"))


def covered(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """k1, k2 and the set ``gone`` of line numbers that later occurrences cover, for documents that have any."""
    found = written(windows(documents, width), "windows")
    place = F.struct("k1", "k2", "at")
    repeated = (found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                .where(F.col("n") > 1).drop("n"))
    later = found.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    return (later.select("k1", "k2", F.explode("at").alias("line"))
            .groupBy("k1", "k2").agg(F.collect_set("line").alias("gone")))


def dedup_lines(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, their texts without repeated windows, under ``doc_``; ``n_lines`` and ``n_removed`` beside."""
    k1, k2 = _keys(documents)
    rows = documents.select(k1.alias("k1"), k2.alias("k2"), F.struct(*documents.columns).alias("doc_"))
    out = rows.join(covered(documents, width), ["k1", "k2"], "left")
    out = out.withColumn("lines", F.split("doc_.text", "\n", -1))
    lines = F.col("lines")
    # the places that stay, by one hashed set difference
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("doc_.text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return out.select(F.col("doc_").withField("text", text).alias("doc_"),
                      F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def clean(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without repeated windows; those that lose every line with a word go."""
    out = dedup_lines(documents, width)
    return out.where((F.col("n_removed") == 0) | F.col("doc_.text").rlike(WORD)).select("doc_.*").select(*documents.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cleaned text."""
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_.doc_id", "n_lines", "n_removed", "doc_.text")


OP6_SQL = r"""
with line as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where text is not null),
word as (
  select doc_id, i, line, lead(line, 1) over d as l1, lead(line, 2) over d as l2, lead(i, 1) over d as i1, lead(i, 2) over d as i2
  from line where regexp_matches(line, '[^\x20\x09-\x0D]')
  window d as (partition by doc_id order by i)),
later as (
  select doc_id, i, i1, i2 from (
    select *, row_number() over (partition by line, l1, l2 order by doc_id, i) as nth from word where i2 is not null)
  where nth > 1),
gone as (
  select doc_id, i from later union select doc_id, i1 from later union select doc_id, i2 from later),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed,
    coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.i is null), '') as text
  from line l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, k.text
from documents d left join kept k on d.doc_id = k.doc_id
"""
