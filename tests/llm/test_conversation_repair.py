"""Conversation repair against plain enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from routewise.llm import conversation_repair as op

EMPTY = hashlib.sha256(b"").hexdigest()


def all_repairs(initials, marks, most_inserts=2):
    """Every (cost, audit, roles) whose roles follow the grammar, by trying every edit of every turn."""
    out = []

    def go(i, cost, audit, roles, inserts):
        if not re.fullmatch(r"(s?(ua)*u?)?", roles):
            return
        if i == len(initials) and re.fullmatch(r"(s?(ua)+)?", roles):
            out.append((cost, audit))
        if inserts < most_inserts:
            for c in "ua":
                go(i, cost + 5, audit + "I", roles + c, inserts + 1)
        if i == len(initials):
            return
        go(i + 1, cost + 2, audit + "D", roles, 0)
        if marks[i] in (op.FINE, op.TRUNCATED):
            cut = 5 if marks[i] == op.TRUNCATED else 0
            go(i + 1, cost + cut, audit + "K", roles + initials[i], 0)
            for c in "ua":
                if c != initials[i]:
                    go(i + 1, cost + cut + 1, audit + "R", roles + c, 0)
    go(0, 0, "", "", 0)
    return out


def walked(initials, marks):
    """Least (cost, audit) by carrying the best audit of each state of the grammar."""
    best = {0: (0, "")}
    nexts = {0: "su", 1: "u", 2: "a", 3: "u"}

    def inserted(best):
        for _ in range(2):
            for q, (cost, audit) in list(best.items()):
                c = "a" if q == 2 else "u"
                way = (cost + 5, audit + "I")
                best[op.AFTER[c]] = min(best.get(op.AFTER[c], way), way)
        return best
    for c, mark in zip(initials, marks):
        new = {}
        for q, (cost, audit) in inserted(dict(best)).items():
            ways = [(q, 2, "D")]
            if mark in (op.FINE, op.TRUNCATED):
                cut = 5 if mark == op.TRUNCATED else 0
                ways += [(op.AFTER[x], cut + (x != c), "K" if x == c else "R") for x in nexts[q] if x == c or x != "s"]
            for q2, more, edit in ways:
                new[q2] = min(new.get(q2, (1 << 60, "")), (cost + more, audit + edit))
        best = new
    best = inserted(dict(best))
    return min(best[q] for q in (0, 3) if q in best)


def test_every_short_conversation():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for marks in itertools.product((op.FINE, op.BLANK, op.TRUNCATED), repeat=n):
                got = op.repair("".join(initials), marks)
                assert got == min(all_repairs(initials, marks)), (initials, marks)


def test_random_conversations():
    random.seed(3)
    for _ in range(400):
        n = random.randint(4, 60)
        initials = "".join(random.choice("uuuuaaaasx") for _ in range(n))
        marks = tuple(random.choice((0, 0, 0, 1, 2, 3, 3)) for _ in range(n))
        assert op.repair(initials, marks) == walked(initials, marks)


def test_band_holds_every_cheapest_cell():
    """A wider band changes nothing."""
    random.seed(4)
    for _ in range(50):
        n = random.randint(1, 30)
        initials = "".join(random.choice("uas") for _ in range(n))
        marks = tuple(random.choice((0, 0, 3)) for _ in range(n))
        bound = op.incumbent(initials, marks, 0, 3)
        narrow, wide = (op.suffix_costs(initials, marks, 3, b) for b in (bound, 10 * n + 50))
        least = wide[0].min()
        assert least <= bound
        for r in range(narrow.shape[1]):
            if wide[0, r] <= bound:
                assert narrow[0, r] == wide[0, r]


def plain(rows):
    """The contract's columns for one conversation's damaged (turn, role, text)."""
    rows = sorted(rows, key=lambda r: ((0,) if r[0] is None else (1, r[0]), r[1], r[2]))
    marks, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        marks.append(op.BLANK if not body else op.DUPLICATE if (role, text) in seen else op.FINE if body[-1] in ".!?" else op.TRUNCATED)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = walked(["-" if not c else c for c in initials], marks)
    out, state, k = [], 0, 0
    for edit in audit:
        _, role, text = (None, None, "") if edit == "I" else rows[k]
        k += edit != "I"
        if edit != "D":
            role = role if edit == "K" else "assistant" if state == 2 else "user"
            state = op.AFTER[role[0]]
            out.append((role, text, edit))
    known = [r[0] for r in rows if r[0] is not None]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, marks.count(op.BLANK), marks.count(op.DUPLICATE),
            marks.count(op.TRUNCATED), sum(a + b not in op.LEGAL for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in out).encode()).hexdigest()), out


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = ("user" if kind == 4 else " " if role is None else role), " " if text is None else text
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        kept += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def odd_rows():
    random.seed(8)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Ünï 日本 😀.", "long " * 20_000 + "end.", "é.", "Yes. \n"]
    roles = ["user", "assistant", "system", "tool", "User", "", None, "übung"]
    rows = []
    for conv in [None, *range(40)]:
        for k in range(random.randint(1, 12)):
            turn = None if random.random() < .1 else random.choice([k, k, k, 2 * k, -3])
            role = random.choice(roles) if random.random() < .4 else ("user", "assistant")[k % 2]
            rows += [(conv, turn, role, random.choice(texts))] * (1 + (random.random() < .15))
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("gone", "mark", "initial", "pos", "block", "kind", "col", "count"):
        if c != "gone":
            df = df.withColumn(c, F.lit("extra"))
    got = {r["conv_id"]: tuple(r)[1:] for r in op.repaired(op.damage(df)).collect()}
    want = {c: plain(r)[0] for c, r in damaged(rows).items()}
    assert got == want
    turns = {}
    for r in op.repaired_turns(op.damage(df)).orderBy("position").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    assert turns == {c: out for c, r in damaged(rows).items() if (out := plain(r)[1])}
    nothing = df.limit(0)
    assert op.repaired(op.damage(nothing)).count() == 0 and op.repaired_turns(nothing).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64])
def test_long_conversations_in_blocks(spark, monkeypatch, block):
    """The way of long conversations gives what the whole alignment gives."""
    monkeypatch.setattr(op, "LONG_TURNS", 5)
    monkeypatch.setattr(op, "BLOCK", block)
    rows = odd_rows()
    random.seed(9)
    rows += [(100, k, random.choice(["user", "assistant", "assistant", "system"]), random.choice(["a.", "b", "c!", "", f"t{k}."])) for k in range(300)]
    rows += [(101, None, "user", "same.")] * 200  # one checksum: all dropped, all kept or all damaged alike
    rows += [(c, None, "user", "gone") for c in range(200, 230) for _ in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in op.repaired(op.damage(df)).collect()}
    want = {c: plain(r) for c, r in damaged(rows).items()}
    assert got == {c: w[0] for c, w in want.items()}
    assert any(not damaged(rows)[c] for c in range(200, 230)) and got[next(c for c in range(200, 230) if not damaged(rows)[c])][-1] == EMPTY
    if block == 3:
        turns = {}
        for r in op.repaired_turns(op.damage(df)).orderBy("position").collect():
            turns.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
        assert turns == {c: w[1] for c, w in want.items() if w[1]}


def test_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 5, "user", "Bye")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = op.repaired(df).first()
    assert (r["gaps"], r["truncated"], r["cost"], r["audit"]) == (3, 1, 2, "KKD")
    assert r["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Hello.").hexdigest()
