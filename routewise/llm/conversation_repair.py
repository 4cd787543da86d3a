"""Conversation structure repair by Wagner-Fischer alignment with the alternating grammar.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Turns are aligned with each feasible length
of that string: targets share their ends, so one matrix of suffix costs (turns left x target letters
left) holds the cost of every length, and those that begin with a system turn extend it by one letter.
An incumbent, a repair found by one greedy walk, bounds the cost; only cells that a repair of at most that
cost can pass are filled (Ukkonen's band: a target shorter by k letters takes k deletions, a longer one k
insertions).  Every length that reaches the least cost is traced back to its least audit, and the audits are
compared.

Conversations of up to ``LONG_TURNS`` rows meet whole in one task, sorted by Spark.  The rows of longer
ones are sorted over all tasks and cut into blocks of ``BLOCK`` positions.  Each block is aligned for every state
of the grammar that it can begin and end in, all blocks at once, and the blocks' costs and audits are then put
together in order.  Of equally dear audits for the same turns none is the beginning of the other, so the
least audit of the whole consists of least audits of its parts.  The text of a long conversation passes one
task only for its checksum, as a stream, with nothing kept but the audit.

Defined cases: rows are taken by turn (nulls first), then role, then text by code points; a null role or
text is one space (so such a text is blank); null conv_ids are one conversation; repeated rows are
duplicates; a role's initial is its first character as it stands; a kept turn keeps its role; an empty table
gives no rows; only conv_id, turn, role and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm.common import written
from routewise.llm.spelling import CRC_SQL, crc_sql
from routewise.sources.tables import read_table

SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
ROLES = {"u": b"user", "a": b"assistant"}
LEGAL = ("su", "ua", "au")
#: What a row's first fault is.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the grammar: nothing yet, after s, after u, after a.  The next letter in each, and where a letter leads.
NEXT, AFTER = "uuau", {"s": 1, "u": 2, "a": 3}
NO_COST = 1 << 40
LONG_TURNS, BLOCK = 1024, 256
#: (entry, exit) states of a block between which there is a repair.
PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))


# ---- alignment of some turns, given as initials and marks ----

def _keep(mark: int) -> int | None:
    """What an undeleted row adds; None where it must go."""
    return None if mark in (BLANK, DUPLICATE) else CUT if mark == TRUNCATED else 0


def incumbent(initials: str, marks: tuple, entry: int, end: int) -> int:
    """Cost of the repair that keeps what fits, deletes the rest and inserts what the end still needs."""
    state, cost = entry, 0
    for c, mark in zip(initials, marks):
        if mark == FINE and (c == NEXT[state] or c == "s" and state == 0):
            state = AFTER[c]
        else:
            cost += DELETE
    return cost + INSERT * {(2, 3): 1, (3, 2): 1, (0, 2): 1, (1, 2): 1, (0, 3): 2, (1, 3): 2}.get((state, end), 0)


def suffix_costs(initials: str, marks: tuple, end: int, bound: int) -> np.ndarray:
    """Cost of aligning the turns from i on with the last r letters of a target that ends in state ``end``.

    Cells that no repair of at most ``bound`` passes hold NO_COST or more.
    """
    n = len(initials)
    width = n + bound // INSERT + 1
    out = np.full((n + 1, width), NO_COST, np.int64)
    r = np.arange(width)
    letters = np.where(r % 2 == 1, NEXT[5 - end], NEXT[end])  # the r-th letter from the end
    out[n] = INSERT * r
    for i in range(n - 1, -1, -1):
        low, high = max(0, n - i - bound // DELETE), n - i + bound // INSERT + 1
        row = out[i + 1, low:high] + DELETE
        if (keep := _keep(marks[i])) is not None:
            first = max(low, 1)
            aligned = out[i + 1, first - 1:high - 1] + (keep + REROLE * (letters[first:high] != initials[i]))
            np.minimum(row[first - low:], aligned, out=row[first - low:])
        step = INSERT * r[low:high]
        out[i, low:high] = np.minimum.accumulate(row - step) + step
    return out


def _trace(costs: np.ndarray, initials: str, marks: tuple, end: int, i: int, r: int) -> str:
    """The least of the cheapest audits of the turns from i on for r letters, letter by letter: D, I, K, R."""
    out, n = [], len(initials)
    while i < n or r:
        cost, letter = costs[i, r], NEXT[5 - end] if r % 2 else NEXT[end]
        if i < n and cost == costs[i + 1, r] + DELETE:
            out.append("D")
            i += 1
        elif r and cost == costs[i, r - 1] + INSERT:
            out.append("I")
            r -= 1
        else:
            out.append("K" if initials[i] == letter else "R")
            i, r = i + 1, r - 1
    return "".join(out)


@lru_cache(maxsize=20_000)
def align(initials: str, marks: tuple, entry: int, end: int) -> tuple[int, str] | None:
    """Least cost and its least audit for the turns, from one state of the grammar to another."""
    n = len(initials)
    found = [(DELETE * n, "D" * n)] if entry == end else []
    system = [i for i in range(n) if initials[i] == "s" and _keep(marks[i]) is not None] if entry == 0 else []
    if end == 1:
        found += [(DELETE * (n - 1) + _keep(marks[i]), "D" * i + "K" + "D" * (n - 1 - i)) for i in system]
    elif end > 1:
        costs = suffix_costs(initials, marks, end, incumbent(initials, marks, entry, end))
        first = NEXT[entry]
        lengths = [r for r in range(1, costs.shape[1]) if (NEXT[5 - end] if r % 2 else NEXT[end]) == first]
        # with a leading system turn: the rows before it go
        after = {i: min(((int(costs[i + 1, r]), r) for r in lengths), default=(NO_COST, 0))[0] for i in system}
        heads = {i: DELETE * i + _keep(marks[i]) for i in system}
        least = min([*(int(costs[0, r]) for r in lengths), *(heads[i] + after[i] for i in system)], default=NO_COST)
        if least < NO_COST and (not found or least <= found[0][0]):
            found += [(least, _trace(costs, initials, marks, end, 0, r)) for r in lengths if costs[0, r] == least]
            found += [(least, "D" * i + "K" + _trace(costs, initials, marks, end, i + 1, r))
                      for i in system for r in lengths if heads[i] + costs[i + 1, r] == least]
    return min(found, default=None)


def repair(initials: str, marks: tuple) -> tuple[int, str]:
    """Least cost and its least audit for a whole conversation."""
    return min(align(initials, marks, 0, 0), align(initials, marks, 0, 3))


class Replay:
    """Applies an audit to turns as they come; gives the repaired (role, text, edit)."""

    def __init__(self, state: int = 0):
        self.state, self.ops = state, iter("")

    def begin(self, audit: str) -> None:
        self.ops = iter(audit)

    def _new(self, text: bytes, edit: str) -> tuple[bytes, bytes, str]:
        letter = NEXT[self.state]
        self.state = AFTER[letter]
        return ROLES[letter], text, edit

    def turn(self, initial: str, role: bytes, text: bytes) -> Iterator[tuple[bytes, bytes, str]]:
        for op in self.ops:
            if op == "I":
                yield self._new(b"", op)
                continue
            if op == "K":
                self.state = AFTER[initial]
                yield role, text, op
            elif op == "R":
                yield self._new(text, op)
            return

    def rest(self) -> Iterator[tuple[bytes, bytes, str]]:
        """Insertions after the last turn."""
        for op in self.ops:
            yield self._new(b"", op)


class Digest:
    """Checksum of repaired turns, joined by newlines."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, turns: Iterable[tuple[bytes, bytes, str]]) -> None:
        for role, text, _ in turns:
            if self.some:
                self.sha.update(b"\n")
            self.sha.update(role + b":")
            self.sha.update(text)
            self.some = True

    def value(self) -> str:
        return self.sha.hexdigest()


def illegal(initials: list[str] | str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


# ---- rows ----

def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that their checksum names; a dropped row stays, marked ``gone``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    df = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                   (F.col("kind") == 0).alias("gone"), F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))))
    return df.drop("col")


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with their initial and the faults that a row has by itself."""
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    df = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"),
                              F.when(gone, "").otherwise(space("text")).alias("text"), gone.alias("gone"))
    end = F.rtrim("text", F.lit(SPACES))
    mark = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    return df.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), mark.alias("mark"), "gone",
                     F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))


ORDER = ("conv_id", "turn", "role", "text")  # ascending, nulls first


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, row) for each row of sorted batches."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[0], row[1:]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    rows, key, some = [], None, False
    for conv, row in _groups(batches):
        if some and conv != key:
            yield key, rows
            rows = []
        key, some = conv, True
        rows.append(row)
    if some:
        yield key, rows


REPAIRED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv_id bigint, position bigint, edit string, role string, text string"
CHUNK = 2_000


def _batches(rows: Iterable[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    kinds = [(p.split(" ")[0], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[p.split(" ")[1]]) for p in ddl.split(", ")]
    schema, held, size = pa.schema(kinds), [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) == CHUNK or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _whole(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple]:
    """Results of whole conversations, or their repaired turns."""
    for conv, rows in _conversations(batches):
        rows = [r for r in rows if not r[3]]
        seen, marks = set(), []
        for _, _, mark, _, role, text in rows:
            marks.append(DUPLICATE if mark != BLANK and (role, text) in seen else mark)
            seen.add((role, text))
        initials = [r[1] for r in rows]
        # an empty role has no initial; any letter of no role stands for it
        cost, audit = repair("".join(c or "-" for c in initials), tuple(marks))
        replay, digest, at = Replay(), Digest(), 0
        replay.begin(audit)
        for _, initial, _, _, role, text in [*rows, (None,) * 6]:
            done = list(replay.rest() if role is None else replay.turn(initial, role, text))
            digest.add(done)
            if turns:
                yield from ((conv, at + k, edit, r.decode("utf-8", "replace"), t.decode("utf-8", "replace")) for k, (r, t, edit) in enumerate(done))
            at += len(done)
        if not turns:
            known = {r[0] for r in rows if r[0] is not None}
            yield (conv, max(known) - min(known) + 1 - len(known) if known else 0, marks.count(BLANK), marks.count(DUPLICATE),
                   marks.count(TRUNCATED), illegal(initials), cost, audit, digest.value())


# ---- long conversations ----

def _sorted_over_all(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, which rises in their order; sorted in ranges, so no conversation needs one task.

    Fully equal rows take any order among themselves; a spread key lets their ranges be cut.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    order = [*ORDER, "spread"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("spread")
    return written(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _marked(turns: DataFrame) -> DataFrame:
    """conv_id, pos, block, turn, initial and the mark with duplicates."""
    first = (turns.where(F.col("mark") != BLANK).groupBy("conv_id", "role", "text").agg(F.min("pos").alias("pos"))
             .select("pos", F.lit(True).alias("first")))
    mark = F.when((F.col("mark") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("mark"))
    return turns.drop("role", "text").join(first, "pos", "left").select(
        "conv_id", "pos", _block(), "turn", "initial", mark.alias("mark"))


def _block():
    return F.floor(F.col("pos") / BLOCK).alias("block")


def _aligned_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("entry", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    for batch in batches:
        out = {"conv_id": batch.column("conv_id"), "block": batch.column("block"), "first": [], "last": [], "illegal": [], "ways": []}
        for rows in batch.column("rows").to_pylist():
            initials, marks = [r["initial"] for r in rows], tuple(r["mark"] for r in rows)
            text = "".join(c or "-" for c in initials)
            ways = [(entry, end, align(text, marks, entry, end)) for entry, end in PAIRS]
            out["first"].append(initials[0])
            out["last"].append(initials[-1])
            out["illegal"].append(illegal(initials))
            out["ways"].append([{"entry": a, "end": b, "cost": w[0], "audit": w[1]} for a, b, w in ways if w])
        yield pa.RecordBatch.from_arrays(
            [out["conv_id"], out["block"], pa.array(out["first"], pa.string()), pa.array(out["last"], pa.string()),
             pa.array(out["illegal"], pa.int64()), pa.array(out["ways"], pa.list_(kind))], names=list(out))


WAYS = "conv_id bigint, block bigint, first string, last string, illegal bigint, ways array<struct<entry:bigint,end:bigint,cost:bigint,audit:string>>"


def _less(a: tuple, b: tuple) -> bool:
    """Whether one path's audits come before the other's; a path is (cost, audit of the last block, entry, path before)."""
    x, y = [], []
    while a is not b and (a or b):  # all before a shared path is equal
        x.append(a[1])
        y.append(b[1])
        a, b = a[3], b[3]
    return "".join(reversed(x)) < "".join(reversed(y))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per conversation the cheapest way through its blocks: conv_id, block, entry, audit, cost and illegal of the whole."""
    for conv, blocks in _block_groups(batches):
        best, wrong, before, numbers = {0: (0, "", 0, None)}, 0, None, []
        for block, first, last, inside, ways in blocks:
            wrong += inside + (before is not None and before + first not in LEGAL)
            before, new = last, {}
            numbers.append(block)
            for w in ways:
                if w["entry"] in best:
                    path = (best[w["entry"]][0] + w["cost"], w["audit"], w["entry"], best[w["entry"]])
                    held = new.get(w["end"])
                    if held is None or path[0] < held[0] or path[0] == held[0] and _less(path, held):
                        new[w["end"]] = path
            best = new
        done = [best[s] for s in (0, 3) if s in best]
        path = done[0] if len(done) == 1 or done[0][0] < done[1][0] or done[0][0] == done[1][0] and _less(*done) else done[1]
        cost, steps = path[0], []
        while path[3] is not None:
            steps.append((path[2], path[1]))
            path = path[3]
        for block, (entry, audit) in zip(numbers, reversed(steps)):
            yield conv, block, entry, audit, cost, wrong


def _block_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, iterator of its blocks), without holding a conversation's blocks."""
    from itertools import groupby
    for conv, group in groupby(_groups(batches), key=lambda x: x[0]):
        yield conv, (row for _, row in group)


FOLDED = "conv_id bigint, block bigint, entry bigint, audit string, cost bigint, illegal bigint"


def _replayed(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple]:
    """Results of long conversations from their blocks' audits, each followed by its rows."""
    for conv, rows in _block_groups(batches):
        replay, digest, audits, cost, wrong, at = Replay(), Digest(), [], 0, 0, 0
        for _, pos, initial, role, text, entry, audit, whole_cost, whole_wrong in rows:
            done = list(replay.rest()) if pos is None else list(replay.turn(initial, role, text))
            digest.add(done)
            if turns:
                yield from ((conv, at + k, edit, r.decode("utf-8", "replace"), t.decode("utf-8", "replace")) for k, (r, t, edit) in enumerate(done))
            at += len(done)
            if pos is None:
                replay.begin(audit)
                audits.append(audit)
                cost, wrong = whole_cost, whole_wrong
        done = list(replay.rest())
        digest.add(done)
        if turns:
            yield from ((conv, at + k, edit, r.decode("utf-8", "replace"), t.decode("utf-8", "replace")) for k, (r, t, edit) in enumerate(done))
        else:
            yield conv, wrong, cost, "".join(audits), digest.value()


def _long(rows: DataFrame, ids: DataFrame, turns: bool) -> DataFrame:
    ordered = _sorted_over_all(rows.where(~F.col("gone")).drop("gone"))
    marked = written(_marked(ordered), "marked")
    blocks = marked.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "initial", "mark"))).alias("rows"))
    ways = written(blocks.mapInArrow(_aligned_blocks, WAYS), "ways")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = written(ways.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block")
                     .mapInArrow(lambda b: _batches(_folded(b), FOLDED), FOLDED), "folded")
    none = lambda kind: F.lit(None).cast(kind)
    heads = folded.select("conv_id", "block", none("long").alias("pos"), none("string").alias("initial"), none("binary").alias("role"),
                          none("binary").alias("text"), "entry", "audit", "cost", "illegal")
    body = ordered.select("conv_id", _block(), "pos", "initial", "role", "text", none("long").alias("entry"), none("string").alias("audit"),
                          none("long").alias("cost"), none("long").alias("illegal"))
    stream = heads.unionByName(body).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block", "pos")
    if turns:
        return stream.mapInArrow(lambda b: _batches(_replayed(b, True), TURNS), TURNS)
    ddl = "conv_id bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    done = stream.mapInArrow(lambda b: _batches(_replayed(b, False), ddl), ddl)
    some = lambda m: F.sum((F.col("mark") == m).cast("long"))
    counts = marked.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("range"), some(BLANK).alias("blank"),
                                           some(DUPLICATE).alias("duplicate"), some(TRUNCATED).alias("truncated"))
    distinct = marked.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("turn").alias("distinct"))
    out = ids.select("conv_id")
    for part in (counts, distinct, done):
        part = part.withColumnRenamed("conv_id", "part_id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("part_id")), "left").drop("part_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("conv_id", zero(F.col("range") - F.col("distinct")).alias("gaps"),
                      *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _repaired(conversations: DataFrame, turns: bool) -> DataFrame:
    rows = _turns(conversations)
    long = written(rows.groupBy("conv_id").count().where(F.col("count") > LONG_TURNS).select("conv_id"), "long")
    ddl, some = TURNS if turns else REPAIRED, not long.isEmpty()
    named = long.withColumnRenamed("conv_id", "long_id")
    match = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(named, match, "left_anti") if some else rows
    out = (short.repartition("conv_id").sortWithinPartitions(*ORDER)
           .mapInArrow(lambda b: _batches(_whole(b, turns), ddl), ddl))
    return out.unionByName(_long(rows.join(named, match, "left_semi"), long, turns)) if some else out


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost and audit of the repair, checksum of what it gives."""
    return _repaired(conversations, False)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role and text."""
    return _repaired(conversations, True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and checksum of every damaged and repaired conversation."""
    return repaired(damage(read_table(spark, sf_dir, "conversations")))


#: Walks the grammar's states turn by turn; between two turns one insertion is enough.
OP11_SQL = rf"""
with recursive {CRC_SQL},
hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as h
  from conversations, crc_table),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text
  from hashed, range(2) c(copy) where h <> 0 and (copy = 0 or h = 3)),
row as (
  select conv_id, turn, role, text, left(role, 1) as initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i
  from damaged),
marked as (
  select *, case when body = '' then 'b' when i > min(i) over (partition by conv_id, role, text) then 'd' when right(body, 1) in ('.', '!', '?') then 'f' else 't' end as mark,
    lag(initial) over (partition by conv_id order by i) as before
  from row),
insertion(q, q2, role) as (
  values (0, 0, null), (1, 1, null), (2, 2, null), (3, 3, null), (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
letter(q, q2, c, role) as (values (0, 1, 's', null), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'), (2, 3, 'a', 'assistant')),
walk(conv_id, i, q, best) as (
  select distinct conv_id, 0::bigint, 0, {{'cost': 0::bigint, 'audit': '', 'turns': []::varchar[]}} from conversations
  union all
  select conv_id, i, q, min(best) from (
    select w.conv_id, r.i, coalesce(l.q2, n.q2) as q, {{
      'cost': w.best.cost + case when n.role is null then 0 else 5 end
        + case when l.q2 is null then 2 else case when l.c = r.initial then 0 else 1 end + case when r.mark = 't' then 5 else 0 end end,
      'audit': w.best.audit || case when n.role is null then '' else 'I' end
        || case when l.q2 is null then 'D' when l.c = r.initial then 'K' else 'R' end,
      'turns': w.best.turns || case when n.role is null then []::varchar[] else [n.role || ':'] end
        || case when l.q2 is null then []::varchar[] else [case when l.c = r.initial then r.role else l.role end || ':' || r.text] end}} as best
    from walk w join insertion n on w.q = n.q
    join marked r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1
    join (select * from letter union all select q, null, null, null from (values (0), (1), (2), (3)) s(q)) l
      on l.q = n.q2 and (l.q2 is null or r.mark in ('f', 't') and (l.c = r.initial or l.role is not null)))
  group by conv_id, i, q),
ended as (
  select w.conv_id, w.i, min(case when q = 2 then {{'cost': best.cost + 5, 'audit': best.audit || 'I', 'turns': best.turns || ['assistant:']}} else best end) as best
  from walk w where q in (0, 2, 3) group by w.conv_id, w.i),
counted as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (mark = 'b') as blank,
    count(*) filter (mark = 'd') as duplicate, count(*) filter (mark = 't') as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, e.best.cost as cost, e.best.audit as audit, sha256(array_to_string(e.best.turns, chr(10))) as repaired_sha256
from ended e left join counted c on e.conv_id is not distinct from c.conv_id
where e.i = coalesce(c.n, 0)
"""
