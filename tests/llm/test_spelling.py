"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from routewise.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_vocabulary(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:])


def plain(vocab):
    out = {}
    for w, n in vocab.items():
        near = sorted((-m, v) for v, m in vocab.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = [form, n, len(near), vocab[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def found(df):
    return {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in df.collect()}


def test_against_brute_force(spark):
    random.seed(5)
    base = ["".join(random.choice("abcdeéñÿ") for _ in range(random.randint(5, 8))) for _ in range(40)]
    words = []
    for w in base:
        for _ in range(random.randint(1, 30)):
            k, kind = random.randrange(len(w)), random.random()
            c = random.choice("abcdeÀ÷")
            words += random.randint(1, 4) * [w if kind < .4 else w[:k] + w[k + 1:] if kind < .6 else w[:k] + c + w[k + 1:] if kind < .8 else w[:k] + c + w[k:]]
    random.shuffle(words)
    rows = [(i // 50, " ".join(w.upper() if random.random() < .2 and w.isascii() else w for w in words[i:i + 50])) for i in range(0, len(words), 50)]
    want = plain(plain_vocabulary(rows))
    assert len(want) > 100 and sum(r[0] is not None for r in want.values()) > 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for symbols in (None, 2, 7):  # the alphabet never changes the result
        assert found(spelling.variants(df, symbols)) == want


def test_damage_hits(spark, tiny):
    rows = tiny.execute("select doc_id, text from documents").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(spelling.damaged_runs(df)).collect()}
    assert got == plain_vocabulary(rows)


def test_long_words(spark):
    """Words around the border between the two ways, and one of 50,000 letters, with every kind of edit at every place."""
    random.seed(6)
    vocab = {}
    for size in (spelling.LONG_WORD - 1, spelling.LONG_WORD, spelling.LONG_WORD + 1, 200):
        w = "".join(random.choice("abcdefgh") for _ in range(size))
        vocab[w] = 100
        for k in (0, 1, size // 2 - 1, size // 2, size // 2 + 1, size - 2, size - 1):
            vocab[w[:k] + w[k + 1:]] = 7
            vocab[w[:k] + "z" + w[k + 1:]] = 8
            vocab[w[:k] + "y" + w[k:]] = 9
        vocab[w + "y"] = 10
    huge = "x" * 50_000
    vocab |= {huge: 50, huge[1:]: 3, huge[:20_000] + "y" + huge[20_001:]: 4, huge + "xx": 5}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    assert found(spelling.with_roots(spelling.forms(df))) == plain(vocab)


def test_chains(spark):
    """Each word twice as frequent as the one before: one chain over ten words."""
    words = ["aaaaaaaaaa"[:k] + "bbbbbbbbbb"[k:] for k in range(11)]
    vocab = {w: 3 * 2 ** k for k, w in enumerate(words)}
    got = found(spelling.with_roots(spelling.forms(spark.createDataFrame(list(vocab.items()), "word string, n long"))))
    assert got == plain(vocab) and got[words[0]][4] == words[-1]


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert found(spelling.variants(odd.withColumn("word", F.lit("extra")))) == plain(plain_vocabulary(rows))
    assert spelling.variants(nothing).count() == 0


def test_alphabet_grows():
    assert [spelling.symbols_for(n) for n in (0, 10 ** 5, 10 ** 7, 10 ** 9)] == [4, 4, 6, 11]
