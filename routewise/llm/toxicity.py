"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs to Latin letters and digits or signs inside words to the letters
they stand for.  Folding keeps one character for each, so a hit's position is its place in the text.
A term is a whole word or a word beginning; it counts where it starts a word (and, as a whole word,
ends one) and holds a letter of the original text.  A hit inside an exception phrase does not count.
The weighted hits are normalised by length, and a logistic curve turns that into a score.

Terms and weights are learned from labelled rows: a term must stand in several toxic documents behind
different words, more often than chance gives, and be rare in the other documents; of terms that begin alike the one found in most
toxic documents is taken, and its weight is the log odds of its document counts.  Two-word phrases in which a term stands in documents
that are not toxic become exceptions.

Defined cases: a null or empty text has no hit and gets the score of zero hits; repeated rows and ties
score alike; an empty table gives no rows; without labelled toxic rows the lexicon is empty; only
doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import chunks, label_rows, text_bytes, training_texts
from routewise.sources.tables import read_table

#: Letters that look like the Latin letters below them.
LOOKS = ("авсеніјкморѕтухαεικνορτυχıԁԛԝ",
         "abcehijkmopstyxaeikvoptuxidqw")
DIGITS = (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"))
SIGNS = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])|(?<!\S)[@$](?=[^\W\d_])")
#: Bound of the training sample: documents and bytes of whole text per class.
PER_CLASS, CLASS_BYTES = 4000, 16 << 20
FOLDS, HELD_OUT = 5, 0
FLAG_FROM = 0.5
#: A term needs so many toxic documents, and so many different words before it (copies of one text have one), at most so large a
#: share in other documents for its share in toxic ones, and chance must give it so many toxic ones with this probability at most.
MIN_DOCS, MIN_CONTEXTS, MAX_SHARE, MAX_CHANCE = 5, 5, 0.04, 1e-4
STEMS = (4, 5, 6, 7)
#: Benign phrases known beforehand; learned ones come on top.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum")


class _Fold(dict):
    """Code point to folded character."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        plain = unicodedata.normalize("NFKC", c).lower()
        c = self[point] = plain if len(plain) == 1 else c
        return c


FOLD = _Fold({ord(a): b for a, b in zip(*LOOKS)})
for _a, _b in zip(*LOOKS):
    FOLD.setdefault(ord(_a.upper()), _b)
#: Finds a character that folding may change; of Latin letters and punctuation, those that it leaves alone are passed over.
ODD = re.compile("[^\x00-\x7f%s]" % "".join(c for c in map(chr, (*range(0x80, 0x250), *range(0x2000, 0x2070))) if FOLD[ord(c)] == c))


def fold(text: str) -> str:
    """The folded text, as long as the text."""
    out = text.lower()
    if len(out) != len(text):  # a capital whose small form has two characters
        out = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    if not out.isascii() and ODD.search(out):
        out = out.translate(FOLD)
    for a, b in DIGITS:
        out = out.replace(a, b)
    if "@" in out or "$" in out:
        out = SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", out)
    return out


@dataclass(frozen=True)
class Lexicon:
    """terms: folded term, whole word or not, weight; curve: weights of ln(1 + hits' weight) and of their density, and bias."""
    terms: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


class Matcher:
    """Finds a lexicon's hits in a text."""

    def __init__(self, terms, exceptions):
        self.machine = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for term, whole, weight in terms:
            found.setdefault(term, []).append((whole, weight))
        for phrase in exceptions:
            found.setdefault(phrase, [])
        for key, kinds in found.items():
            self.machine.add_word(key, (len(key), kinds, key in set(exceptions)))
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each counted hit, by start; of several terms at one start the heaviest counts."""
        if self.empty or not text:
            return []
        out: dict[int, tuple[int, int, float]] = {}
        benign = []
        t = fold(text)
        for last, (size, kinds, phrase) in self.machine.iter(t):
            start, end = last - size + 1, last + 1
            if start and t[start - 1].isalpha():
                continue
            ends = end == len(t) or not t[end].isalpha()
            if phrase and ends:
                benign.append((start, end))
            if not any(c.isalpha() for c in text[start:end]):
                continue
            for whole, weight in kinds:
                if (ends or not whole) and (start not in out or out[start][2] < weight):
                    out[start] = (start, end, weight)
        return [h for _, h in sorted(out.items()) if not any(a <= h[0] and h[1] <= b for a, b in benign)]


WORD = re.compile(r"[^\W\d_]+")


def measure(matcher: Matcher, text: str) -> tuple[float, float]:
    """ln(1 + the hits' weight), and that weight per 100 words."""
    total = sum(w for *_, w in matcher.hits(text))
    return (math.log1p(total), 100 * total / max(1, len(text.split()))) if total else (0.0, 0.0)


def chance(toxic: int, clean: int, part: float) -> float:
    """Probability of ``toxic`` or more toxic ones among so many documents, where ``part`` of all documents are toxic."""
    n = toxic + clean
    if part >= 1:
        return 0.0  # nothing to compare with
    at = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(part) + (n - k) * math.log1p(-part)
          for k in range(toxic, n + 1)]
    return min(1.0, sum(map(math.exp, at)))


def learn(samples: list[tuple[int, str]], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Terms, exceptions and curve from labelled texts; equal texts count once."""
    texts = [(y, fold(t)) for t, y in {t: y for y, t in samples}.items()]
    toxic = [t for y, t in texts if y]
    clean = [t for y, t in texts if not y]
    if not toxic:
        return Lexicon((), tuple(exceptions), (0.0, 0.0, -4.0))

    def terms(t: str) -> dict:
        """Terms of a text, with the words that stand before them."""
        words = WORD.findall(t)
        out: dict = {}
        for before, w in zip(["", *words], words):
            if len(w) >= 3:
                out.setdefault((w, True), set()).add(before)
            for n in STEMS:
                if len(w) >= n:
                    out.setdefault((w[:n], False), set()).add(before)
        return out

    in_toxic: Counter = Counter()
    before: dict = {}
    for t in toxic:
        for x, words in terms(t).items():
            in_toxic[x] += 1
            if len(before.setdefault(x, set())) < MIN_CONTEXTS:
                before[x] |= words
    usable = {x for x, n in in_toxic.items() if n >= MIN_DOCS and len(before[x]) >= MIN_CONTEXTS}
    in_clean: Counter = Counter()
    for t in clean:
        in_clean.update(x for x in terms(t) if x in usable)
    share = {x: (in_clean[x] / max(1, len(clean))) / (in_toxic[x] / len(toxic)) for x in usable}
    part = len(toxic) / len(texts)
    usable = {x for x in usable if share[x] <= MAX_SHARE and chance(in_toxic[x], in_clean[x], part) <= MAX_CHANCE}
    chosen: list = []
    taken: set = set()  # the terms chosen; begun: all they begin with
    begun: set = set()
    # most toxic documents first, less those that chance explains; then the longer, the whole word
    for x in sorted(usable, key=lambda x: (-in_toxic[x] * (1 - share[x] / MAX_SHARE), -len(x[0]), not x[1], x[0])):
        starts = [x[0][:n] for n in range(1, len(x[0]) + 1)]
        if x[0] not in begun and taken.isdisjoint(starts):
            chosen.append(x)
            taken.add(x[0])
            begun.update(starts)
    lift = {x: (in_toxic[x] / len(toxic)) / ((in_clean[x] + 0.5) / (len(clean) + 1)) for x in chosen}
    weighted = tuple((*x, math.log(lift[x])) for x in chosen if lift[x] > 1)
    heads = {x[0] for x in chosen}
    pairs: Counter = Counter()
    for t in clean:
        words = WORD.findall(t)
        pairs.update({f"{a} {b}" for a, b in zip(words, words[1:]) if a in heads or b in heads})
    benign = {p for p, n in pairs.items() if n >= MIN_DOCS and not any(p in t for t in toxic)}
    phrases = tuple(sorted({*map(fold, exceptions), *benign}))
    matcher = Matcher(weighted, phrases)
    points = [(y, *measure(matcher, t)) for y, t in texts]
    return Lexicon(weighted, phrases, curve(points))


def curve(points: list[tuple[int, float, float]]) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a small ridge; weights of hits are not below 0."""
    y = np.array([p[0] for p in points], float)
    x = np.array([[a, min(b, 100.0), 1.0] for _, a, b in points])
    w, ridge = np.zeros(3), np.diag([1e-2, 1e-2, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return (max(0.0, float(w[0])), max(0.0, float(w[1])), float(w[2]))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Lexicon:
    """Learn from ``labels.toxic`` outside the held-out fold; at most ``per_class`` rows and ``class_bytes`` a class."""
    return learn(training_texts(documents, label_rows(labels, "toxic", FOLDS, HELD_OUT), per_class, class_bytes)[0])


def score_column(spark: SparkSession, lexicon: Lexicon, text: str = "text") -> Column:
    """The score of a text column."""
    a, b, bias = lexicon.curve

    @F.arrow_udf("double")
    def toxicity(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon.terms, lexicon.exceptions)
        for part in parts:
            found = []
            for _, texts in chunks(pa.RecordBatch.from_arrays([part], ["text"])):
                for t in texts:
                    x, y = measure(matcher, t.decode("utf-8", "replace"))
                    found.append(1 / (1 + math.exp(-max(-500.0, min(500.0, a * x + b * min(y, 100.0) + bias)))))
            yield pa.array(found, pa.float64())

    return toxicity(text_bytes(text))


def span_column(lexicon: Lexicon, text: str = "text") -> Column:
    """The counted hits of a text column as array<struct<start, end, weight>>, code points, end exclusive."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    @F.arrow_udf("array<struct<start: bigint, end: bigint, weight: double>>")
    def spans(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon.terms, lexicon.exceptions)
        for part in parts:
            yield pa.array([[dict(zip(("start", "end", "weight"), h)) for h in matcher.hits((t or b"").decode("utf-8", "replace"))]
                            for t in part.to_pylist()], kind)

    return spans(text_bytes(text))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    documents = read_table(spark, sf_dir, "documents")
    lexicon = fit(documents, read_table(spark, sf_dir, "labels"))
    fold_ = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    scored = documents.select("doc_id", F.coalesce(fold_ == HELD_OUT, F.lit(False)).alias("held_out"),
                              score_column(spark, lexicon).alias("score"))
    return scored.select("*", (F.col("score") >= FLAG_FROM).cast("int").alias("predicted"))
