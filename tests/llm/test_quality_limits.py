"""Limits of the quality rules against exact quantiles of their groups."""

import random

import numpy as np
from pyspark.sql import functions as F

from routewise.llm import quality_rules as op


def text(rng, symbols, repeats, long):
    words = [rng.choice("abcdefghij") * rng.randint(3, 6) + str(rng.randint(0, 10 ** 6)) + "x" * long for _ in range(120)]
    words[:repeats] = ["again"] * repeats
    words[60:60 + symbols] = ["#$%"] * symbols
    return "\n".join(" ".join(words[i:i + 10]) for i in range(0, 120, 10))


def documents():
    """Two languages; one source with many documents, one with few, and a language with few in all."""
    rng, rows = random.Random(4), []
    for lang, source, n, dirty, long in (("a", "big", 900, .08, 0), ("a", "small", 30, .5, 0), ("b", "big", 700, .02, 6), ("c", "only", 40, .1, 2), (None, None, 300, .1, 0)):
        for _ in range(n):
            bad = rng.random() < dirty
            rows.append((len(rows), text(rng, rng.randint(5, 30) if bad else 0, rng.randint(0, 8) if bad else 0, long), lang, source))
    rows.append((len(rows), None, "a", "big"))
    return rows


def exact_bounds(values, mid, edge, far, slack=0.01):
    """The limit's range when each quantile may be off by ``slack`` in rank (the sketch's error)."""
    q = lambda r, s: float(np.quantile(values, min(1, max(0, r + s)), method="lower" if s < 0 else "higher"))
    ends = [e + op.SPREAD * (e - m) + op.TAIL * (f - e) for m in (q(mid, -slack), q(mid, slack))
            for e in (q(edge, -slack), q(edge, slack)) for f in (q(far, -slack), q(far, slack))]
    return min(ends) - 1e-9, max(ends) + 1e-9


def test_limits_are_the_groups_own_quantiles(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string")
    measured = op.metrics(df).cache()
    rows = op._ratios(measured).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["lang"], r["source"]), []).append(r)
    by_lang = {lang: [r for (x, _), g in groups.items() if x == lang for r in g] for lang in ("a", "b", "c", None)}
    judged_by = {("a", "big"): groups["a", "big"], ("a", "small"): by_lang["a"], ("b", "big"): groups["b", "big"],
                 ("c", "only"): rows, (None, None): groups[None, None]}
    found = {(r["g_lang"], r["g_source"]): r for r in op.limits(measured).collect()}
    assert set(found) == set(groups)
    for key, rest in judged_by.items():
        for m in op.METRICS:
            values = [r[m] for r in rest if r[m] is not None]     # all documents, those that fail the base rules too
            low, high = exact_bounds(values, op.MEDIAN, op.EDGE, op.EXTREME)
            assert low <= found[key][f"{m}_max"] <= high, (key, m)
        low, high = exact_bounds([r["word_length"] for r in rest if r["word_length"] is not None], op.MEDIAN, 1 - op.EDGE, 1 - op.EXTREME)
        assert low <= found[key]["word_length_min"] <= high
    for m in ("symbol_ratio", "word_length"):     # no constant: each group has its own
        assert len({round(r[f"{m}_max"], 6) for r in found.values()}) >= 4


def test_outliers_go_and_the_bulk_stays(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string")
    rows = [r for r in op.verdicts(df).collect() if not r["base_failed"]]
    clean, dirty = [r for r in rows if not r["n_symbols"]], [r for r in rows if r["n_symbols"] >= 45]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)
    assert sum(not r["kept"] for r in dirty) >= 0.6 * len(dirty) > 0
    assert op.verdicts(df.where(F.lit(False))).count() == 0
