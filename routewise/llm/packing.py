"""Sum-of-squares packing of documents into sequences of fixed length.

A document is its token ids and an end mark.  Documents longer than a sequence are cut into full pieces
and a rest; full pieces are sequences of their own.  All other pieces are dealt by a hash into groups of
about ``GROUP`` pieces, as many as there are pieces for, and each group is packed by itself, longest
pieces first: a piece goes where the sum over gaps of the squared number of open sequences with that gap
becomes smallest, the smallest such gap on ties.

Defined cases: a null text is empty, and an empty text is the end mark alone; ties and repeated rows are
packed like any other; a null doc_id stays null; an empty table gives no rows; only doc_id and text are
read; a text of any length is tokenised whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import WordTable, chunks, per_text_sum, text_bytes, worker_kept, written
from routewise.sources.tables import read_table

LENGTH = 4096
END = 1
GROUP = 8192
TOKENIZER = "word_bpe_49k.json"
#: Units and words whose ids a worker remembers, and new words learnt together: the ids of a call take room.
UNIT_CAP, WORD_CAP, STEP = 150_000, 300_000, 65_536


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _extended(kept: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``kept`` with ``new`` behind its first ``used`` values, in a buffer that doubles."""
    if used + len(new) > len(kept):
        kept = np.concatenate([kept[:used], np.empty(used + len(new), kept.dtype)])
    kept[used:used + len(new)] = new
    return kept


class _Rows:
    """Arrays of token ids, one after another."""

    def __init__(self):
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rows = self.size = 0

    def add(self, flat: np.ndarray, length: np.ndarray) -> None:
        self.start = _extended(self.start, self.rows, self.size + np.cumsum(length) - length)
        self.length = _extended(self.length, self.rows, length)
        self.flat = _extended(self.flat, self.size, flat)
        self.rows, self.size = self.rows + len(length), self.size + len(flat)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the given rows, and how many each has."""
        n = self.length[rows]
        return self.flat[np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


class Encoder:
    """Token ids of whole texts, word by word: this tokenizer drops white space and no token spans it.

    It also ignores case and never joins letters with other signs, so words are remembered in small
    letters, and a word of Latin letters with a point or comma behind it as its two units.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.ends = np.zeros(1 + max(self.model.get_vocab().values()), bool)  # tokens that end a word
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.reset()
        self.reset_units()
        self.table = WordTable(self.derive, self.reset, WORD_CAP)

    def reset(self) -> None:
        self.words = _Rows()

    def reset_units(self) -> None:
        self.unit, self.units = {}, _Rows()

    def _learn(self, new: list[bytes]) -> None:
        """Add units that are not known yet: all words of Latin letters in one call, the others one by one."""
        texts = [u.decode("utf-8", "replace") for u in new]
        plain = [t.isalpha() and max(t) < "\u0100" for t in texts]
        letters = [t for t, p in zip(texts, plain) if p]
        order = [u for u, p in zip(new, plain) if p]
        if letters:
            ids = np.array(self.model.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(letters):
                self.units.add(ids, np.diff(last, prepend=-1))
            else:
                order, plain = [], [False] * len(new)
        rest = [i for i, p in enumerate(plain) if not p]
        order += [new[i] for i in rest]
        rows = [e.ids for e in self.model.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        self.units.add(np.fromiter(chain.from_iterable(rows), np.uint32, int(n.sum())), n)
        self.unit |= {u: len(self.unit) + i for i, u in enumerate(order)}

    def derive(self, words: list[bytes]) -> None:
        for at in range(0, len(words), STEP):
            self._derive(words[at:at + STEP])

    def _derive(self, words: list[bytes]) -> None:
        if len(self.unit) > UNIT_CAP:
            self.reset_units()
        parts: list[bytes] = []
        count = np.ones(len(words), np.int64)
        for i, w in enumerate(words):
            core = w[:-1]
            if w[-1] in b".," and core and (core.isalpha() or core.decode("utf-8", "replace").isalpha() and max(core.decode("utf-8", "replace")) < "\u0100"):
                parts += (core, w[-1:])
                count[i] = 2
            else:
                parts.append(w)
        new = list(dict.fromkeys(p for p in parts if p not in self.unit))
        if new:
            self._learn(new)
        flat, n = self.units.take(np.fromiter(map(self.unit.__getitem__, parts), np.int64, len(parts)))
        self.words.add(flat, per_text_sum(n, count).astype(np.int64))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, without an end mark."""
        # capitals could hide a special token's string
        ids, counts = self.table.encode([t if b"<|" in t else t.lower() for t in texts])
        tokens, n = self.words.take(ids)
        return np.split(tokens, np.cumsum(per_text_sum(n, counts))[:-1])


def pieces(documents: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and ids, as little-endian bytes) of each piece."""
    path = path or tokenizer_path()
    rows = documents.select("doc_id", text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_kept(("encoder", path), lambda: Encoder(path))
        for batch in batches:
            for part, texts in chunks(batch):
                at, cut, payload = [], [], []
                for i, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), length)):
                        piece = ids[start:start + length].tobytes()
                        at.append(i)
                        cut.append((k, start, len(piece) // 4, zlib.crc32(piece)))
                        if with_ids:
                            payload.append(piece)
                table = np.array(cut, np.int64).reshape(-1, 4).T
                columns = [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(table[0], pa.int32()),
                           *(pa.array(x) for x in table[1:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(payload, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                           + (", ids binary" if with_ids else ""))


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece shorter than the capacity; the pieces are taken as they come."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # change of the sum of squares: a new sequence, or each gap that there is
        least, gap = 2 * count[capacity - size] + 1, capacity
        found = size + np.flatnonzero(count[size:capacity])
        if len(found):
            change = np.where(found > size, 2 * count[found - size] + 1, 0) + 1 - 2 * count[found]
            k = int(change.argmin())
            if change[k] <= least:
                gap = int(found[k])
        if gap == capacity:
            to, opened = opened, opened + 1
        else:
            count[gap] -= 1
            to = gaps[gap].pop()
        sequence[i], offset[i] = to, capacity - gap
        if gap > size:
            count[gap - size] += 1
            gaps[gap - size].append(to)
    return sequence, offset


def place(found: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    short = found.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, rows["offset"] = pack(rows["length"].to_numpy(), length)
        rows["sequence_id"] = -1 - sequence - (int(rows["group_"].iloc[0]) << 32)
        return rows.drop(columns="group_")

    schema = found.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    packed = short.withColumn("group_", key).groupBy("group_").applyInPandas(run, schema + ", offset long, sequence_id long")
    full = found.where(F.col("length") == length).select(
        "*", F.lit(0).cast("long").alias("offset"), F.monotonically_increasing_id().alias("sequence_id"))
    return packed.unionByName(full)


def pack_documents(documents: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Every piece of every document with its place."""
    return place(written(pieces(documents, path, length), "pieces"), length)


def sequences(documents: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """sequence_id and ids (little-endian bytes, at most ``length`` ids) of each packed sequence."""
    placed = place(written(pieces(documents, path, length, with_ids=True), "pieces"), length)
    return (placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
