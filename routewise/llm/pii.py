"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame expressions only.  The matches of a pattern (``regexp_extract_all``) and the text between them
(``split``) alternate, so the lengths of both give every match its place, in code points, end exclusive.

Kinds email, ip, card and phone are kept whenever their check holds (parts of at most 255; 13 to 19 digits
passing Luhn; 9 to 15 digits); a match that fails is dropped without another try.  Kinds iban (mod 97) and
ssn are added where the score, which a context word nearby raises, reaches ``KEEP_FROM``.

The patterns are the plain ones with possessive repeats and look-behinds, which give the same matches but
neither recurse nor start again inside a run; places are summed in chunks and texts are looked into by segments, so
that a match costs the same in a text of any length.

Defined cases: a null text is empty and has no spans; ties and repeated rows are treated alike; an empty
table gives no rows; extra columns pass through ``redact`` and are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.sources.tables import read_table

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]++"
#: Patterns by kind, in the order of the output.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Scores of a confirmed match, and words nearby that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"mail|contact|write", "ip": r"\bip\b|address|host|server", "card": r"card|visa|credit|payment",
    "phone": r"phone|tel|call|mobile|fax", "iban": r"iban|bank|account|konto|cuenta|compte",
    "ssn": r"\bssn\b|social|security|tax",
}
CONTEXT_SCORE, KEEP_FROM, BEFORE, AFTER = 0.35, 0.5, 40, 20


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 1, F.try_to_number(d, F.lit("9")).cast("int") * 2).otherwise(F.try_to_number(d, F.lit("9")).cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without spaces leaves 1 by mod 97, letters standing for 10 to 35."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    value = F.transform(F.split(moved, ""), lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    return F.lit(True)


#: Matches are summed up in chunks of so many, and texts are looked into by segments of so many code points, so that
#: neither a text's length nor the number of its matches enters the cost of one match.
CHUNK, SEGMENT = 64, 1024
#: The columns that hold what lambdas refer to are named more than once in each expression that uses them: the optimizer
#: then keeps them as columns and does not put their expression into the lambda.


def _segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SEGMENT}}}+"), F.lit(0))


def _cut(segments: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (from 0) of a text given as segments."""
    first, last = F.floor(start / SEGMENT), F.floor((start + length - 1) / SEGMENT)
    part = F.array_join(F.slice(segments, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "")
    return F.substr(part, (start - first * SEGMENT + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int"))


def _chunks(items: str) -> Column:
    """The elements of an array column in arrays of CHUNK."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(CHUNK))
    return F.transform(starts, lambda i: F.slice(items, i + 1, CHUNK))


def _sums_before(chunks: str) -> Column:
    """Code points before each chunk of (hit, gap) pairs."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("list"))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, p: s + p["gap"] + F.length(p["hit"]))
    return F.aggregate(chunks, begin, lambda a, c: F.struct(
        (a["at"] + size(c)).alias("at"), F.concat(a["list"], F.array(a["at"])).alias("list")), lambda a: a["list"])


def _places(chunks: str) -> Column:
    """start and end of each hit, from the lengths of hits and of the text before each."""
    def inside(chunk: Column, before: Column) -> Column:
        begin = F.struct(before.alias("at"), F.array().cast("array<struct<hit:string,start:bigint,end:bigint>>").alias("found"))

        def step(a: Column, p: Column) -> Column:
            start = a["at"] + p["gap"]
            end = start + F.length(p["hit"])
            return F.struct(end.alias("at"), F.concat(a["found"], F.array(F.struct(
                p["hit"].alias("hit"), start.alias("start"), end.alias("end")))).alias("found"))

        return F.aggregate(chunk, begin, step, lambda a: a["found"])

    return F.flatten(F.zip_with(chunks, _sums_before(chunks), inside))


def with_spans(df: DataFrame, text: str, out: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Adds ``out``: array<struct<kind, start, end, score>> by kind as listed, then start."""
    mark = f"{out}__"
    kept = [*df.columns, out]
    df = df.withColumn(f"{mark}text", F.coalesce(F.col(text), F.lit("")))
    whole, segments = F.col(f"{mark}text"), F.col(f"{mark}segments")
    df = df.withColumns({f"{mark}{k}": F.regexp_extract_all(whole, F.lit(PATTERNS[k]), F.lit(0)) for k in kinds})
    # most texts hold nothing: only the others are cut into segments
    some = F.greatest(*(F.size(f"{mark}{k}") for k in kinds), F.lit(0)) > 0
    df = df.withColumn(f"{mark}segments", F.when(some, _segments(whole)))

    def pairs(kind: str) -> Column:
        hits = F.col(f"{mark}{kind}")
        gaps = F.when(F.size(hits) > 0, F.split(whole, PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>"))
        return F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap")))

    df = df.withColumns({f"{mark}{k}_pairs": F.when(F.size(f"{mark}{k}") > 0, pairs(k)) for k in kinds})
    df = df.withColumns({f"{mark}{k}_chunks": F.when(F.size(f"{mark}{k}") > 0, _chunks(f"{mark}{k}_pairs")) for k in kinds})
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")

    def found(kind: str) -> Column:
        def near(s: Column) -> Column:
            start = F.greatest(F.lit(0).cast("long"), s["start"] - BEFORE)
            return F.lower(F.concat_ws(" ", _cut(segments, start, s["start"] - start), _cut(segments, s["end"], F.lit(AFTER))))

        scored = F.transform(F.filter(_places(f"{mark}{kind}_chunks"), lambda s: _confirmed(kind, s["hit"])), lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near(s).rlike(CONTEXT[kind]), CONTEXT_SCORE).otherwise(0.0))
            .alias("score")))
        if kind not in BASE:
            scored = F.filter(scored, lambda s: s["score"] >= KEEP_FROM)
        return F.when(F.size(f"{mark}{kind}") > 0, scored).otherwise(none)

    return df.withColumn(out, F.concat(*(found(k) for k in kinds))).select(*kept)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_redacted(df: DataFrame, text: str, spans: str) -> DataFrame:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    mark = f"{spans}__"
    col = lambda name: F.col(f"{mark}{name}")
    kept = df.columns
    df = df.withColumn(f"{mark}sorted", F.when(F.size(spans) > 0, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))))
    some = F.size(f"{mark}sorted") > 0
    df = df.withColumns({f"{mark}chunks": F.when(some, _chunks(f"{mark}sorted")), f"{mark}segments": F.when(some, _segments(F.col(text)))})
    # a span begins a new one where it starts at or after the furthest end so far; ends by chunk first
    begin = F.struct(F.lit(0).cast("long").alias("top"), F.array().cast("array<bigint>").alias("list"))
    tops = F.aggregate(f"{mark}chunks", begin, lambda a, c: F.struct(
        F.greatest(a["top"], F.array_max(F.transform(c, lambda s: s["end"]))).alias("top"),
        F.concat(a["list"], F.array(a["top"])).alias("list")), lambda a: a["list"])

    def inside(chunk: Column, top: Column) -> Column:
        first = F.struct(top.alias("top"), F.array().cast("array<struct<start:bigint,kind:string,top:bigint,first:boolean>>").alias("list"))

        def step(a: Column, s: Column) -> Column:
            far = F.greatest(a["top"], s["end"])
            return F.struct(far.alias("top"), F.concat(a["list"], F.array(F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), far.alias("top"), (s["start"] >= a["top"]).alias("first")))).alias("list"))

        return F.aggregate(chunk, first, step, lambda a: a["list"])

    df = df.withColumn(f"{mark}flags", F.flatten(F.zip_with(f"{mark}chunks", tops, inside)))
    df = df.withColumn(f"{mark}at", F.filter(F.transform(f"{mark}flags", lambda s, i: F.when(s["first"], i)), lambda i: i.isNotNull()))
    after = F.concat(F.slice(col("at"), 2, F.greatest(F.size(col("at")), F.lit(1))), F.array(F.size(col("flags"))))
    df = df.withColumn(f"{mark}merged", F.when(F.size(spans) > 0, F.zip_with(col("at"), after, lambda i, j: F.struct(
        F.get(col("flags"), i)["start"].alias("start"), F.get(col("flags"), i)["kind"].alias("kind"), F.get(col("flags"), j - 1)["top"].alias("end")))))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(
        F.slice(col("merged"), 1, F.greatest(F.size(col("merged")) - 1, F.lit(0))), lambda s: s["end"]))
    pieces = F.zip_with(col("merged"), ends, lambda s, last: F.concat(
        _cut(col("segments"), last, s["start"] - last), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    last = F.element_at(col("merged"), -1)["end"]
    rest = _cut(col("segments"), last, F.size(col("segments")) * SEGMENT - last)
    df = df.withColumn(text, F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text)))
    return df.select(*kept)


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data replaced in their texts; all columns stay, a null text stays null."""
    spans = "spans"
    while any(c.startswith(spans) for c in documents.columns):
        spans += "_"
    return _with_redacted(with_spans(documents, text, spans), text, spans).drop(spans)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = with_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "found")
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
                        F.sha2(_joined(of(*BASE)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
