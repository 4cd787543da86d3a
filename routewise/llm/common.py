"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewise.sources.sinks import shared_path

#: Text handled at a time inside a task; a longer single text is handled alone, never cut.
CHUNK_BYTES = 4 << 20
#: Distinct words that a worker remembers between chunks.
WORD_CAP = 300_000
#: A labelled text beyond this part of a class's bytes enters the training sample only after all shorter ones.
LONG_PART = 32
#: Stands for a null id where an id is a join or grouping key.
NO_ID = -(1 << 63)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder and read it back."""
    path = shared_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(col: Column | str = "text") -> Column:
    """A text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def label_rows(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """One row (doc_id, label 0/1) per labelled document outside the held-out fold.

    Rows without id or label and labels other than 0 and 1 are left out; of several labels of one
    document the largest counts.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold != held_out))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def training_texts(documents: DataFrame, rows: DataFrame, per_class: int, max_bytes: int) -> tuple[list, dict]:
    """Labelled whole texts in a fixed pseudo-random order, and the count of labelled rows per class.

    At most ``per_class`` documents of each class, and of those whole texts up to ``max_bytes`` per
    class, reach the driver.  Texts over a ``LONG_PART`` of these bytes come last, the shortest first, and
    take only room that the others leave, so no long text keeps another out.  The chosen ids number
    2 * per_class at most, which bounds the broadcast.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = None
    for label in (0, 1):
        part = rows.where(F.col("label") == label).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = (documents.select("doc_id", "text").where(F.col("text").isNotNull())
             .join(F.broadcast(picked), "doc_id")
             .withColumn("order_", order)
             .groupBy("doc_id", "order_", "label").agg(F.min("text").alias("text")))
    # running size within a class, over the bounded sample only
    bytes_ = F.octet_length("text")
    texts = texts.withColumn("long_", F.when(bytes_ > max_bytes // LONG_PART, bytes_).otherwise(0))
    size = F.sum(bytes_).over(_running("label"))
    out = texts.withColumn("size_", size).where(F.col("size_") <= max_bytes).orderBy("label", "order_")
    return [(r["label"], r["text"]) for r in out.select("label", "text").collect()], counts


def _running(key: str):
    from pyspark.sql import Window
    return Window.partitionBy(key).orderBy("long_", "order_", "doc_id").rowsBetween(Window.unboundedPreceding, 0)


def worker_kept(key: tuple, make: Callable):
    """What ``make`` gives, kept for later tasks of the same Python worker.

    A worker keeps one thing at a time: asked by another key it lets go of the old one and of the memory
    freed with it, so that the stages of a pipeline do not pile up their tables in it.
    """
    kept = sys.modules.setdefault("_llm_kept_by_worker", types.ModuleType("_llm_kept_by_worker"))
    if getattr(kept, "key", None) != key:
        kept.key = kept.value = None
        release_memory()
        kept.value = make()
        kept.key = key
    return kept.value


def release_memory() -> None:
    """Give freed memory back to the system; the allocators of C and Arrow would keep it for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, each word's number among them, and the number of words of each text."""
    try:
        parts = pa.compute.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    except pa.ArrowInvalid:  # not UTF-8
        parts = pa.array([t.split() for t in texts], pa.list_(pa.binary()))
    counts, words = np.diff(parts.offsets.to_numpy()).astype(np.int64), parts.values
    real = pa.compute.greater(pa.compute.binary_length(words), 0)
    if pa.compute.any(pa.compute.invert(real)).as_py():  # white space at an end of a text gives an empty part
        counts = per_text_sum(np.asarray(real.to_numpy(zero_copy_only=False)), counts).astype(np.int64)
        words = words.filter(real)
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False), counts


class WordTable:
    """Numbers distinct words, and keeps what ``derive`` makes of each new one.

    Words are maximal runs without the bytes 0x20 and 0x09-0x0D, or what ``split`` gives.  The table is emptied between chunks
    once it holds more than ``cap`` words, so memory stays bounded by the cap and one chunk.
    """

    def __init__(self, derive: Callable[[list[bytes]], None] | None = None,
                 reset: Callable[[], None] | None = None, cap: int = WORD_CAP, split: Callable = split_words):
        self.ids, self.derive, self.reset, self.cap, self.split = _Ids(), derive, reset, cap, split

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the number of words of each text."""
        if len(self.ids) > self.cap:
            self.ids = _Ids()
            if self.reset:
                self.reset()
        before = len(self.ids)
        words, number, counts = self.split(texts)
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))[number]
        if self.derive and len(self.ids) > before:
            self.derive(list(islice(self.ids, before, None)))
        return ids, counts


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about CHUNK_BYTES of text each, and their texts."""
    col = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > CHUNK_BYTES:
            part = batch.slice(at, i - at)
            yield part, [x or b"" for x in part.column(column).to_pylist()]
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        part = batch.slice(at)
        yield part, [x or b"" for x in part.column(column).to_pylist()]


def per_text_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
