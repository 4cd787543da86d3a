"""SentencePiece encoding and decoding by suffix-array matching.

A text gets a mark for each space and one in front.  No piece has a mark behind another sign or holds a
line break, so a text falls into units (marks and what follows them; a line break; and, as no piece holds
a letter before a point or comma, these) that are encoded by themselves, each distinct one once.  The new units of a chunk are joined, with a zero byte between, and
every position is indexed in a suffix array (ordered by as many bytes as nearly all pieces have).  Each
piece is looked up by binary search; the range of its occurrences gives edges, which are sorted by
position.  The vocabulary is a byte-pair one, so edges are relaxed by score, not by path length: of the
edges that join two neighbouring symbols the best-scored one, leftmost on ties, is taken until none is
left.  (A shortest path over the same edges gives other ids than this vocabulary's own encoder.)  Signs
without a piece become byte pieces.

Defined cases: a null or empty text has no ids; ties and repeated rows are encoded alike; an empty table
gives no rows; only doc_id and text are read.  Decoding gives the text again; a mark in a text (U+2581)
comes back as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import WordTable, chunks, per_text_sum, text_bytes, worker_kept
from routewise.llm.packing import _Rows
from routewise.sources.tables import read_table

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
UNIT_CAP = 300_000
#: Suffixes are ordered by so many bytes; the rest of a longer piece is compared at each place found.
DEPTH = 16
#: New units are indexed together by about so many bytes (a longer unit alone), which bounds the edges held.
INDEXED = 256 << 10
#: Units of more signs are relaxed one by one with a heap.
LONG = 64


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position, as one number that orders like them; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(data)]
    return out


class Vocabulary:
    """Pieces with scores, in arrays."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        raw = [sp.id_to_piece(i).encode() for i in range(n)]
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.id = np.array([i for i in range(n) if not special[i]], np.int64)
        self.piece = [raw[i] for i in self.id]
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.size = np.array([len(p) for p in self.piece], np.int64)
        held = np.zeros((len(self.piece), DEPTH), np.uint8)
        for row, p in zip(held, self.piece):
            row[:min(DEPTH, len(p))] = np.frombuffer(p[:DEPTH], np.uint8)
        most = np.where(np.arange(DEPTH) < self.size[:, None], held, 255).astype(np.uint8)
        self.low = held.view(">u8").astype(np.uint64)
        self.high = most.view(">u8").astype(np.uint64)
        # for decoding: the bytes of each piece
        shown = [b"" if special[i] else raw[i].replace(MARK, b" ") for i in range(n)]
        for b, i in enumerate(self.byte_id):
            shown[i] = bytes([b])
        self.shown = _Rows()
        self.shown.add(np.frombuffer(b"".join(shown), np.uint8).astype(np.uint32), np.array(list(map(len, shown)), np.int64))


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the order of the DEPTH bytes that follow, and those bytes as two numbers each, in that order."""
    one = _words(data)
    two = np.concatenate([one[8:], np.zeros(min(8, len(one)), np.uint64)])
    order = np.argsort(one)
    key = one[order]
    same = np.append(False, key[1:] == key[:-1])
    tied = np.flatnonzero(same | np.append(same[1:], False))
    if len(tied):  # order those with equal first halves by the second
        at, group = order[tied], np.cumsum(~same)[tied]
        order[tied] = at[np.lexsort((two[at], group))]
    return order, one[order], two[order]


def _bound(one: np.ndarray, two: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all keys at once: the number of suffixes before (right: not behind) each key."""
    lo, hi = np.zeros(len(key), np.int64), np.full(len(key), len(one), np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(one) - 1)
        a, b = one[mid], two[mid]
        before = (a < key[:, 0]) | ((a == key[:, 0]) & ((b <= key[:, 1]) if right else (b < key[:, 1])))
        lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    return lo


class Edges:
    """All occurrences of pieces in a text, sorted by position and size."""

    def __init__(self, data: np.ndarray, vocabulary: Vocabulary):
        order, one, two = suffix_array(data)
        first = _bound(one, two, vocabulary.low, False)
        n = _bound(one, two, vocabulary.high, True) - first
        which = np.repeat(np.arange(len(n)), n)
        at = order[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]
        size = vocabulary.size[which]
        for k in np.flatnonzero(size > DEPTH).tolist():
            piece = vocabulary.piece[which[k]]
            if data[at[k]:at[k] + len(piece)].tobytes() != piece:
                size[k] = 0
        real = size > 0
        key = at[real] * 64 + size[real]  # the longest piece has 48 bytes
        by = np.argsort(key)
        self.key, self.id = key[by], vocabulary.id[which[real][by]]
        self.score = vocabulary.score[self.id]

    def find(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The edge over each span, or -1."""
        key = np.where(size < 64, start * 64 + size, -1)
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def scores(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.find(start, size)
        return np.where(at >= 0, self.score[at] if len(self.score) else 0.0, -np.inf)


def relax(edges: Edges, start: np.ndarray, unit: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The starts of the symbols left when no edge joins two neighbours; all units step together."""
    done = []
    if not len(start):
        return start
    size = np.append(start[1:], 0) - start
    last = np.append(unit[1:] != unit[:-1], True)
    size[last] = ends[unit[last]] - start[last]
    score = np.full(len(start), -np.inf)
    stale = ~last
    while len(start):
        k = np.flatnonzero(stale)
        score[k] = edges.scores(start[k], size[k] + size[k + 1])
        score[last] = -np.inf
        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.maximum.reduceat(score, heads)
        count = np.diff(np.append(heads, len(start)))
        alive = np.repeat(best > -np.inf, count)
        done.append(start[~alive])
        hit = np.flatnonzero(alive & (score == np.repeat(best, count)))
        hit = hit[np.append(True, unit[hit][1:] != unit[hit][:-1])] if len(hit) else hit  # leftmost of each unit
        size[hit] += size[hit + 1]
        last[hit] = last[hit + 1]
        stale = np.zeros(len(start), bool)
        stale[hit] = True
        before = hit[(hit > 0)] - 1
        stale[before[unit[before] == unit[before + 1]]] = True
        keep = alive
        keep[hit + 1] = False
        start, unit, size, last, score, stale = (v[keep] for v in (start, unit, size, last, score, stale))
        stale &= ~last
    return np.sort(np.concatenate(done)) if done else start


def relax_long(edges: Edges, start: np.ndarray, end: int) -> np.ndarray:
    """The same for one long unit, with a heap of edges between neighbours."""
    n = len(start)
    begin = start.tolist() + [end]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []
    first = edges.scores(start[:-1], np.append(start[2:], end) - start[:-1])
    for i in np.flatnonzero(first > -np.inf).tolist():
        heap.append((-first[i], i, begin[after[after[i]]] - begin[i]))
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            size = begin[after[j]] - begin[i]
            s = float(edges.scores(np.array([begin[i]]), np.array([size]))[0])
            if s > -np.inf:
                heapq.heappush(heap, (-s, i, size))

    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or begin[after[j]] - begin[i] != size:
            continue  # one of the two has been joined with another since
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return start[np.array(alive)]


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.reset()
        points = not any(POINT.search(p) for p in self.vocabulary.piece)
        self.table = WordTable(self.derive, self.reset, UNIT_CAP, lambda texts: split_units(texts, points))

    def reset(self) -> None:
        self.units = _Rows()

    def derive(self, units: list[bytes]) -> None:
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units))) // INDEXED
        for at in np.split(np.arange(len(units)), np.flatnonzero(np.diff(ends)) + 1):
            self.encode_units([units[i] for i in at.tolist()])

    def encode_units(self, units: list[bytes]) -> None:
        """Index some units together, match all pieces, relax, and keep the ids."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        data = np.frombuffer(b"\0".join(units) + b"\0", np.uint8)
        edges = Edges(data, self.vocabulary)
        ends = np.cumsum(size + 1) - 1
        unit = np.repeat(np.arange(len(units)), size + 1)
        inside = np.ones(len(data), bool)
        inside[ends] = False
        sign = np.flatnonzero(inside & ((data & 0xC0) != 0x80))
        of = unit[sign]
        signs = np.bincount(of, minlength=len(units))
        long = np.flatnonzero(signs > LONG)
        few = signs[of] <= LONG
        left = [relax(edges, sign[few], of[few], ends)]
        left += [relax_long(edges, sign[of == u], int(ends[u])) for u in long]
        start = np.sort(np.concatenate(left))
        of = unit[start]
        stop = np.append(start[1:], 0)
        final = np.append(of[1:] != of[:-1], True)
        stop[final] = ends[of[final]]
        edge = edges.find(start, stop - start)
        # a symbol is one id, or one per byte where it has no piece
        n = np.where(edge >= 0, 1, stop - start)
        ids = np.repeat(np.where(edge >= 0, edges.id[edge] if len(edges.id) else 0, -1), n)
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ids = np.where(ids >= 0, ids, self.vocabulary.byte_id[data[at]]).astype(np.uint32)
        self.units.add(ids, np.bincount(of, n, len(units)).astype(np.int64))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, counts = self.table.encode(texts)
        tokens, n = self.units.take(ids)
        return np.split(tokens, np.cumsum(per_text_sum(n, counts).astype(np.int64))[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids, without the mark in front."""
        out = self.vocabulary.shown.take(ids.astype(np.int64))[0].astype(np.uint8).tobytes()
        return out[1:] if out[:1] == b" " else out


POINT = re.compile(rb"(?<=[A-Za-z])(?=[.,])")


def _cut(text: bytes, points: bool) -> bytes:
    """The text with marks, cut by spaces into units; with ``points`` also between a letter and a point or comma."""
    if not text:
        return text
    if text[:1] == b" " or b"  " in text or MARK in text:
        parts = (MARK + text.replace(b" ", MARK)).split(MARK)
        out, marks = [], b""
        for part in parts[1:]:
            marks += MARK
            if part:
                out.append(marks + part)
                marks = b""
        text = b" ".join([*out, marks])
    else:
        text = MARK + text.replace(b" ", b" " + MARK)
    text = text.replace(b"\n", b" \n ")
    return POINT.sub(b" ", text) if points else text


def split_units(texts: list[bytes], points: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct units of some texts, each unit's number among them, and the number of units of each text."""
    col = pa.array([_cut(t, points) for t in texts], pa.binary())
    parts = pa.compute.split_pattern(col, b" ")
    counts, units = np.diff(parts.offsets.to_numpy()).astype(np.int64), parts.values
    real = pa.compute.greater(pa.compute.binary_length(units), 0)
    counts = per_text_sum(np.asarray(real.to_numpy(zero_copy_only=False)), counts).astype(np.int64)
    coded = units.filter(real).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), counts


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, as bytes) of each whole text."""
    path = path or model_path()
    rows = documents.select("doc_id", text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_kept(("codec", path), lambda: Codec(path))
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(
                    [i.astype("<u4").tobytes() for i in codec.encode(texts)], pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, n_ids and ids_crc32 of rows of ``encoded``; bytes that are no UTF-8 become U+FFFD."""
    path = path or model_path()
    rows = tokens.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_kept(("codec", path), lambda: Codec(path))
        for batch in batches:
            for part, ids in chunks(batch, "ids"):
                texts = [codec.decode(np.frombuffer(i, "<u4")).decode("utf-8", "replace") for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([zlib.crc32(i) for i in ids], pa.int64())], names=["doc_id", "text", "n_ids", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_ids long, ids_crc32 long")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's ids, and size and checksum of what they decode to."""
    back = decoded(encoded(read_table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n_ids", "ids_crc32", F.octet_length("text").cast("long").alias("decoded_bytes"),
                       F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))
