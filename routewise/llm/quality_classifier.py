"""Quality classifier: averaged hashed word and character n-gram vectors, softmax, numpy SGD.

Every word gives a bucket for itself, buckets for its character n-grams, and a repeated word gives
the bucket of the echo bigram.  A document is the mean of its buckets' vectors; a softmax over the
two labels follows.  Training runs on the driver over a bounded sample of labelled rows (see
``fit``); scoring runs in the tasks.  Because the mean and the output layer are linear, a bucket's
vector enters a score only through one number, so the tasks get one float per bucket.

Defined cases: a null or empty text has no buckets and gets the score of the output bias; repeated
rows and ties score alike; an empty table gives no rows; without labelled rows of both classes every
text gets the share of label 1 (1.0 without any labels); extra columns are never read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import WordTable, chunks, label_rows, per_text_sum, text_bytes, training_texts, worker_kept
from routewise.sources.tables import read_table

BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 4)
ECHO = 0
#: Bound of the training sample: documents and bytes of whole text per class.
PER_CLASS, CLASS_BYTES = 2500, 12 << 20
EPOCHS, RATE, BATCH = 6, 40.0, 32
#: Small samples are gone over more often, up to so many steps.
LEAST_STEPS = 900
FOLDS, HELD_OUT = 4, 2
KEEP_FROM = 0.7
#: Words of more bytes are hashed by numpy, this many characters at a time.
LONG, BLOCK = 128, 1 << 17
#: CRC-32's table: the checksum of a byte alone, without the inversions before and after.
TABLE = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
#: New words looked at together.
STEP = 8192


def buckets(word: bytes) -> list[int]:
    """Buckets of a word: itself, and the n-grams of its characters between boundary marks."""
    if len(word) > LONG:
        return np.concatenate(list(long_buckets(word))).tolist()
    text = f"<{word.decode('utf-8', 'replace')}>"
    crc = zlib.crc32
    out = [1 + crc(word) % (BUCKETS - 1)]
    for n in NGRAMS:
        out += [1 + crc(text[i:i + n].encode("utf-8", "replace"), n) % (BUCKETS - 1) for i in range(len(text) - n + 1)]
    return out


def long_buckets(word: bytes) -> Iterator[np.ndarray]:
    """The same buckets in another order, in arrays of bounded size."""
    yield np.array([1 + zlib.crc32(word) % (BUCKETS - 1)], np.int64)
    text = f"<{word.decode('utf-8', 'replace')}>"
    for at in range(0, len(text), BLOCK):
        part = text[at:at + BLOCK + max(NGRAMS) - 1]
        data = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        for n in NGRAMS:
            first = starts[:-n][:BLOCK]
            size = starts[n:][:BLOCK] - first
            crc = np.full(len(first), n ^ 0xFFFFFFFF, np.uint32)
            for k in range(int(size.max(initial=0))):
                step = TABLE[(crc ^ data[np.minimum(first + k, len(data) - 1)]) & 0xFF] ^ (crc >> np.uint32(8))
                crc = np.where(k < size, step, crc)
            yield 1 + (~crc).astype(np.int64) % (BUCKETS - 1)


@dataclass(frozen=True)
class Model:
    """One weight per bucket, and the output bias, of log odds of label 1."""
    weight: np.ndarray
    bias: float


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words = text.split()
    flat: list[int] = []
    cache: dict[bytes, list[int]] = {}
    of_long = None
    last = None
    for w in words:
        if len(w) > LONG:
            of_long = np.zeros(BUCKETS, np.int64) if of_long is None else of_long
            for part in long_buckets(w):
                np.add.at(of_long, part, 1)
        else:
            if w not in cache:
                cache[w] = buckets(w)
            flat += cache[w]
        if w == last:
            flat.append(ECHO)
        last = w
    ids, n = np.unique(np.asarray(flat, np.int64), return_counts=True)
    if of_long is not None:
        of_long[ids] += n
        ids = np.flatnonzero(of_long)
        n = of_long[ids]
    return ids, (n / max(1, n.sum())).astype(np.float32)


def train(samples: list[tuple[int, str]], share: float, seed: int = 7) -> Model:
    """Minibatch SGD on the softmax loss; classes weigh as their share of all labelled rows."""
    rng = np.random.default_rng(seed)
    rows = [(y, *features(t.encode("utf-8", "replace"))) for y, t in samples]
    rows = [r for r in rows if len(r[1])]
    n1 = sum(y for y, *_ in rows)
    n0 = len(rows) - n1
    prior = math.log(max(share, 1e-3) / max(1 - share, 1e-3))
    if not n0 or not n1:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    weigh = {1: share * len(rows) / n1, 0: (1 - share) * len(rows) / n0}
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.array([-prior / 2, prior / 2], np.float32)
    epochs = max(EPOCHS, math.ceil(LEAST_STEPS / math.ceil(len(rows) / BATCH)))
    steps, done = epochs * math.ceil(len(rows) / BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at:at + BATCH]]
            y = np.array([p[0] for p in part])
            ids = np.concatenate([p[1] for p in part])
            share_ = np.concatenate([p[2] for p in part])[:, None]
            row = np.repeat(np.arange(len(part)), [len(p[1]) for p in part])
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            mean = np.add.reduceat(vectors[ids] * share_, starts)
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y] -= 1
            g = p * np.array([weigh[v] for v in y], np.float32)[:, None] / len(part)
            rate = RATE * (1 - done / steps)
            back = (g @ out.T)[row] * share_
            out -= rate / 10 * (mean.T @ g)
            bias -= rate / 100 * g.sum(0)
            distinct, inverse = np.unique(ids, return_inverse=True)
            grads = np.stack([np.bincount(inverse, back[:, d], len(distinct)) for d in range(DIM)], 1)
            vectors[distinct] -= (rate * grads).astype(np.float32)
            done += 1
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    """Fit on ``labels.quality`` outside the held-out fold; at most ``per_class`` rows and ``class_bytes`` a class."""
    samples, counts = training_texts(documents, label_rows(labels, "quality", FOLDS, HELD_OUT), per_class, class_bytes)
    return train(samples, (counts.get(1, 0) + 1e-9) / (sum(counts.values()) + 1e-9))


def scorer(model: Model):
    """A function from a list of texts as bytes to their scores."""
    total, number = np.zeros(0), np.zeros(0)

    def derive(words: list[bytes]) -> None:
        nonlocal total, number
        totals, numbers = [total], [number]
        for at in range(0, len(words), STEP):  # lists of buckets take room
            part = words[at:at + STEP]
            found = [buckets(w) if len(w) <= LONG else [] for w in part]
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
            sums = per_text_sum(model.weight[flat].astype(np.float64), n)
            for i, w in enumerate(part):
                if len(w) > LONG:
                    for ids in long_buckets(w):
                        sums[i] += model.weight[ids].sum(dtype=np.float64)
                        n[i] += len(ids)
            totals.append(sums)
            numbers.append(n)
        total, number = np.concatenate(totals), np.concatenate(numbers)

    def reset() -> None:
        nonlocal total, number
        total, number = np.zeros(0), np.zeros(0)

    table = WordTable(derive, reset)

    def score(texts: list[bytes]) -> np.ndarray:
        ids, counts = table.encode(texts)
        echo = np.zeros(len(ids), bool)
        if len(ids) > 1:
            echo[1:] = ids[1:] == ids[:-1]
            starts = (np.cumsum(counts) - counts)[counts > 0]
            echo[starts] = False
        s = per_text_sum(total[ids] + echo * float(model.weight[ECHO]), counts)
        n = per_text_sum(number[ids] + echo, counts)
        return 1 / (1 + np.exp(-np.clip(model.bias + s / np.maximum(n, 1), -500, 500)))

    return score


def score_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The score of a text column, as a column to select or filter by."""
    shared = spark.sparkContext.broadcast((model.weight, model.bias))  # one number per bucket, 1 MB
    key = ("scorer", uuid.uuid4().hex)

    @F.arrow_udf("double")
    def quality(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = worker_kept(key, lambda: scorer(Model(*shared.value)))
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            found = [score(texts) for _, texts in chunks(batch)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return quality(text_bytes(text))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    documents = read_table(spark, sf_dir, "documents")
    model = fit(documents, read_table(spark, sf_dir, "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    scored = documents.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
                              score_column(spark, model).alias("score"))
    return scored.select("*", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
