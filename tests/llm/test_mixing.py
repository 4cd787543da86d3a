"""Entropy balancing against plain numpy, and the counts and bounds of the contract."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewise.llm import mixing
from routewise.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Sources in code point order, null last; the excess over the bound reshared until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in out]
        left = total - sum(out.values())
        new = {s: most * sizes[s] for s in free if left * weight[s] > most * sizes[s] * sum(weight[x] for x in free)}
        if not new:
            return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        out |= new


def plain_rates(sizes, target, most=3):
    """Sizes of one source: bisection on the dual's only multiplier."""
    sizes = np.array(sizes, float)
    low, high = -1e6, 1e6
    for _ in range(300):
        mid = (low + high) / 2
        words = (sizes * np.exp(np.minimum(mid * sizes / sizes.mean(), math.log(most)))).sum()
        low, high = (mid, high) if words < target else (low, mid)
    return np.exp(np.minimum(low * sizes / sizes.mean(), math.log(most)))


def checked(rows, most=3, near=None):
    """The contract on (source, size, source_size, target, taken) rows."""
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= most * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    want = plain_targets(sizes, most=most)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
    smallest = defaultdict(lambda: 0)
    for r in rows:
        if r["size"]:
            smallest[r["source"]] = min(smallest[r["source"]] or r["size"], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (near or smallest[s] / 2 + 1e-6 * want[s]), (s, taken[s], want[s])
    return want


def rows_of(df):
    return df.select("doc_.doc_id", "doc_.source", "size", "source_size", "target", "rate", "copies",
                     (F.col("size") * F.col("copies")).alias("taken")).collect()


def test_query(spark, tiny):
    source = dict(tiny.execute("select doc_id, source from documents").fetchall())
    text = dict(tiny.execute("select doc_id, text from documents").fetchall())
    rows = [r.asDict() | {"source": source[r["doc_id"]]} for r in QUERIES["op12_mixing"](spark, SF).collect()]
    assert {r["doc_id"]: r["size"] for r in rows} == {d: len((t or "").encode().split()) for d, t in text.items()}
    checked(rows, near=85)  # ten documents a source: half of the shortest at most
    again = QUERIES["op12_mixing"](spark, SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def many(seed=1):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for s, n in (("a", 3000), ("b", 400), ("ä", 50), (None, 300), ("z", 5), ("c", 900)):
        for size in rng.lognormal(3, 1, n).astype(int):
            rows.append((k, " ".join(["w"] * (int(size) + 1)), s))
            k += 1
    return rows


def test_rates_solve_the_dual(spark):
    df = spark.createDataFrame(many(), "doc_id long, text string, source string")
    rows = rows_of(mixing.mixed(df))
    want = checked(rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    assert any(t == 3 * by[s][0]["source_size"] for s, t in want.items())
    for s, own in by.items():
        if want[s] < 3 * own[0]["source_size"]:
            rates = plain_rates([r["size"] for r in own], want[s])
            assert np.allclose([r["rate"] for r in own], rates, rtol=1e-6, atol=1e-9)
        else:
            assert {r["copies"] for r in own} == {3}
        off = [r for r in own if not math.floor(r["rate"] + 1e-9) <= r["copies"] <= math.ceil(r["rate"] - 1e-9)]
        assert len(off) <= 2  # what no rounding of rates can settle


def test_a_group_of_copies_of_a_third_of_all_rows(spark):
    """Fully equal rows share the extras of their size, whatever their number; another layout gives the same."""
    rows = [(None, "one two three four five", "a")] * 2000 + [(k, "x " * (k % 40 + 1), "abc"[k % 3]) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = rows_of(mixing.mixed(df))
    checked(first)
    second = rows_of(mixing.mixed(df.repartition(3, "text")))
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["taken"])
    assert sorted(map(key, first)) == sorted(map(key, second))
    equal = [r["copies"] for r in first if r["doc_id"] is None]
    assert len(equal) == 2000 and max(equal) - min(equal) <= 1


def test_far_targets(spark):
    """Shares far below a source's size, where steps from 0 overshoot, and one long document among short ones."""
    rows = [(k, "w " * (k % 7 + 1), "big") for k in range(5000)] + [(10_000, "w " * 200_000, "big")] + [(20_000, "w", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    checked(rows_of(mixing.mixed(df)), near=200_000)
    hist = mixing.histogram(mixing.sized(df))
    wanted = mixing.targets(hist).withColumn("target", F.when(F.col("source") == "big", 700.0).otherwise(1.0))
    rated = mixing.rates(hist, mixing.multipliers(hist, wanted)).collect()
    assert sum(r["n"] * r["size"] * r["rate"] for r in rated if r["source"] == "big") == pytest.approx(700, rel=1e-6)


def test_mixture_holds_the_copies(spark):
    df = spark.createDataFrame(many(2)[:1500], "doc_id long, text string, source string").withColumn("rate", F.lit("extra"))
    out = mixing.mixture(df)
    assert out.columns == df.columns
    got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert got == {r["doc_id"]: r["copies"] for r in rows_of(mixing.mixed(df)) if r["copies"]}


def test_odd_rows(odd, nothing):
    rows = rows_of(mixing.mixed(odd))
    assert len(rows) == odd.count() and {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    checked(rows, near=60_000)
    assert mixing.mixed(nothing).count() == 0 and mixing.mixture(nothing).columns == nothing.columns
    blank = rows_of(mixing.mixed(odd.where("text is null or doc_id = 3")))
    assert {(r["target"], r["taken"]) for r in blank} == {(0.0, 0)}
