"""Spelling variants: reduced-alphabet generation, checked on the words themselves.

Every letter is hashed to one of a few symbols (its code point modulo their number), so a word has a
reduced word.  Two words one edit apart have reduced words that are equal or one edit apart.  The full
one-edit neighbourhood of every distinct reduced word is generated over the symbols and joined with the
reduced vocabulary, which leaves the pairs of reduced words that both exist; of the two directions of
a pair the one from the smaller reduced word is kept.  The words of each such pair are then joined and
their distance is taken on the original strings.  The number of symbols grows with the vocabulary, so
that the words under one reduced word stay few; it never changes the result.

The neighbourhood of a word of n letters takes n * n room, so words over ``LONG_WORD`` letters go
another exact way: of two words one edit apart, the first or the last half of the shorter one stands
unchanged in both, and words join on these halves.

Occurrences are counted by Spark with partial aggregation, so a frequent word needs no task of its own;
all later work is on the vocabulary.  A form has at least twice the count of its word, so chains are
shorter than 63 and following them takes at most six doublings.

Defined cases: a null or empty text has no words; a null doc_id counts as an empty string in the
checksum; equal rows count each; ties between forms go to the smaller word by code points; an empty
table gives no rows; only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import written
from routewise.sources.tables import read_table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 5, 3, 2
#: One in so many occurrences of ``damaged_runs`` loses a letter.
DAMAGE = 97
#: Words beyond this many code points are joined on their halves.
LONG_WORD = 40
#: The alphabet has LEAST_SYMBOLS symbols, and more once words of SYMBOL_LENGTH letters share a reduced word with more than about SHARED others.
LEAST_SYMBOLS, SYMBOL_LENGTH, SHARED = 4, 7, 50


def runs(documents: DataFrame) -> DataFrame:
    """doc_id and ``run``: every maximal run of letters, A-Z lower-cased."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    return documents.select("doc_id", F.explode(found).alias("run"))


def damaged_runs(documents: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """``word``: the runs of at least ``least`` code points, one in DAMAGE of them without one of its letters."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    df = runs(documents).where(F.length("run") >= least).withColumn("h_", F.crc32(key.cast("binary")))
    at = (F.col("h_") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return df.select(F.when(F.col("h_") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Every distinct ``word`` with its count ``n``, from ``least`` occurrences on."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def symbols_for(n_words: int) -> int:
    """Size of the reduced alphabet for a vocabulary of so many words."""
    return max(LEAST_SYMBOLS, round((n_words / SHARED) ** (1 / SYMBOL_LENGTH)))


def reduced(word: Column, symbols: int) -> Column:
    """The word over the reduced alphabet; characters that are no letters here stay as they are."""
    return F.translate(word, LETTERS, "".join(LOWER[ord(c) % symbols] for c in LETTERS))


def neighbourhood(key: Column, symbols: int) -> Column:
    """The distinct strings at most one edit from a reduced word, itself included."""
    letters = F.array(*(F.lit(c) for c in LOWER[:symbols]))
    head = lambda i: F.substring(key, F.lit(1), i)
    tail = lambda i: F.substring(key, i + 1, F.length(key))
    places = F.sequence(F.lit(0), F.length(key) - 1)
    ends = F.sequence(F.lit(0), F.length(key))
    deleted = F.transform(places, lambda i: F.concat(head(i), tail(i + 1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + 1)))))
    inserted = F.flatten(F.transform(ends, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    return F.array_distinct(F.concat(F.array(key), deleted, replaced, inserted))


def _one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def _short_pairs(vocab: DataFrame, symbols: int) -> DataFrame:
    words = vocab.where(F.length("word") <= LONG_WORD).select("word", "n", reduced(F.col("word"), symbols).alias("key"))
    words = written(words, "reduced")
    keys = written(words.select("key").distinct(), "keys")
    around = keys.select("key", F.explode(neighbourhood(F.col("key"), symbols)).alias("other")).where("other >= key")
    linked = written(around.join(keys.select(F.col("key").alias("other")), "other", "left_semi"), "linked")
    left = words.join(linked, "key").select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key", "other")
    right = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("key").alias("other"))
    pairs = left.join(right, "other").where((F.col("key") != F.col("other")) | (F.col("a") < F.col("b")))
    return pairs.where(_one_edit("a", "b")).select("a", "a_n", "b", "b_n")


def _long_pairs(vocab: DataFrame) -> DataFrame:
    size = F.length("word")
    # from LONG_WORD letters on: the shorter word of a pair may lie on the border
    words = vocab.where(size >= LONG_WORD).select("word", "n", size.alias("size"))
    halves = []
    for shorter in (F.col("size"), F.col("size") - 1):
        half = (shorter / 2).cast("int")
        for end, part in (("head", F.substring("word", F.lit(1), half)), ("tail", F.expr("word").substr(F.col("size") - half + 1, half))):
            halves.append(F.struct(shorter.alias("shorter"), F.lit(end).alias("end"), F.sha2(part, 256).alias("part")))
    keyed = words.select("word", "n", "size", F.explode(F.array(*halves)).alias("at")).select("word", "n", "size", "at.*")
    left = keyed.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size"), "shorter", "end", "part")
    right = keyed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("size").alias("b_size"), "shorter", "end", "part")
    pairs = left.join(right, ["shorter", "end", "part"]).where(
        (F.col("a") < F.col("b")) & (F.least("a_size", "b_size") == F.col("shorter"))
        & (F.greatest("a_size", "b_size") > LONG_WORD) & _one_edit("a", "b"))
    return pairs.select("a", "a_n", "b", "b_n").distinct()


def near_pairs(vocab: DataFrame, symbols: int | None = None) -> DataFrame:
    """a, a_n, b, b_n: every two words one edit apart, each pair once."""
    symbols = symbols or symbols_for(vocab.count())
    return _short_pairs(vocab, symbols).unionByName(_long_pairs(vocab))


def forms(vocab: DataFrame, symbols: int | None = None, factor: int = FORM_FACTOR) -> DataFrame:
    """word, n, n_near, form and form_n: the most frequent near word where it has ``factor`` times the count."""
    pairs = near_pairs(vocab, symbols)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = vocab.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    taken = F.col("form_n") >= factor * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      F.when(taken, F.col("best.near")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """The rows of ``forms`` with ``root``, the last word of each chain; chains are followed by doubling."""
    found = written(found, "forms")
    steps = written(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return found.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(documents: DataFrame, symbols: int | None = None) -> DataFrame:
    """Every word of the documents with its form, root and near words."""
    return with_roots(forms(written(vocabulary(damaged_runs(documents)), "vocabulary"), symbols))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its form and root."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


#: The checksum by its table, bytes from the text's hex form.
CRC_SQL = r"""
crc_table as materialized (
  select list(list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
    case when (c & 1) = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by n) as t
  from range(256) r(n))"""


def crc_sql(text: str) -> str:
    """DuckDB expression for the checksum of an SQL expression's UTF-8 bytes; needs the CTE ``crc_table`` in the query's FROM."""
    hexed = f"hex(encode({text}))"
    byte = f"list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || {hexed}[i:i+1])::bigint)"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: "
            "xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint)")


OP13_SQL = rf"""
with recursive {CRC_SQL},
run as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') as run from documents),
once as (select doc_id, run, count(*) as k from run where length(run) >= 5 group by 1, 2),
hashed as (
  select run, k, {crc_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from once, crc_table),
vocab as (
  select word, sum(k)::bigint as n from (
    select k, case when h % 97 = 0 then run[:(h % length(run))] || run[(h % length(run)) + 2:] else run end as word from hashed)
  where length(word) >= 5 group by 1 having sum(k) >= 3),
cut as (
  select word, n, i, word[:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from vocab)),
near as (
  select distinct c.word as a, v.word as b, v.n as b_n from cut c join vocab v on c.rest = v.word
  union select distinct v.word, c.word, c.n from cut c join vocab v on c.rest = v.word
  union select c.word, d.word, d.n from cut c join cut d on c.i = d.i and c.rest = d.rest where c.word <> d.word),
best as (
  select a, count(*) as n_near, first(b order by b_n desc, b) as b, max(b_n) as b_n from near group by a),
form as (
  select word, n, coalesce(n_near, 0) as n_near, case when b_n >= 2 * n then b end as form, case when b_n >= 2 * n then b_n end as form_n
  from vocab left join best on word = a),
chain(word, here, step) as (
  select word, word, 0 from form
  union all select c.word, f.form, c.step + 1 from chain c join form f on c.here = f.word where f.form is not null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n
from form f join (select word, arg_max(here, step) as root from chain group by word) r on f.word = r.word
"""
