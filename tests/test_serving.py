"""Serving from the streams' own state: many micro-batches, restarts, redelivered events, decisions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY

from routewise import constants as C
from routewise.plans.context import Ctx
from routewise.sources import read_attempts
from routewise.streaming import features as SF
from routewise.streaming import serving as SV
from routewise.streaming import sources as SS
from routewise.streaming import state as ST

HOUR = 3600


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """Ten days of attempts as arrivals in 41 slices of six hours, and in 2 slices."""
    a = read_attempts(spark, SF_TINY, HOUR, with_ts=True).where("tick < 240")
    root = tmp_path_factory.mktemp("arrivals")
    return a, {n: SS.write_slices(SS.arrivals(a, HOUR, s * HOUR), str(root / str(n))) for n, s in (("many", 6), ("few", 168))}


@pytest.fixture(scope="module")
def fixed(spark):
    ctx = Ctx(spark, SF_TINY)
    base = spark.createDataFrame([(r, 0.9, 100.0) for r in C.ROUTE_IDS[:3]], "route_id string, route_base_success_rate double, route_base_latency_ms double")
    return ctx.eligibility, base


def run(spark, source, fixed, path, answer=None):
    return SV.serve(spark, SS.read_arrivals(spark, source), fixed[0], fixed[1], 0.9, HOUR, str(path), answer)


def as_rows(df):
    cols = [c for c in df.columns if c != "batch_id"]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect())


def test_many_micro_batches_and_a_restart_give_what_few_do(spark, days, fixed, tmp_path):
    """A micro-batch is lost after its state was written; the restarted run goes on from the state before it."""
    _, sources = days
    fail = {"left": 1}

    def answer(requests, state, shot):
        if fail["left"] and requests.agg(F.max("tick")).first()[0] is not None and requests.agg(F.max("tick")).first()[0] > 60:
            fail["left"] -= 1
            raise RuntimeError("lost")
        return shot

    with pytest.raises(Exception):
        run(spark, sources["many"], fixed, tmp_path / "many", answer)
    many = run(spark, sources["many"], fixed, tmp_path / "many", answer)
    assert many.select("batch_id").distinct().count() >= 40
    few = run(spark, sources["few"], fixed, tmp_path / "few")
    got, want = as_rows(many), as_rows(few)
    assert len(got) == len(want) > 500 and got == want


def test_decisions_are_the_best_scored_once_and_closed_as_a_stream(spark, days, fixed, tmp_path):
    """Chosen routes equal argmax over the same snapshot; a replayed micro-batch writes no second decision."""
    from routewise.operators.policy import policy_argmax
    a, sources = days

    class Model:      # scores by a column, in place of a fitted pipeline
        def transform(self, df):
            from pyspark.ml.functions import array_to_vector
            p = F.coalesce("bank_route_success_rate_15m", F.lit(0.5))
            return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    class Calibrator:
        def transform(self, df):
            return df.withColumn("p", F.round("raw_p", 2))

    decide, fail = SV.decide(Model(), Calibrator()), {"left": 1}

    def answer(requests, state, shot):
        rows = decide(requests, state, shot)
        if fail["left"] and requests.count():
            fail["left"] -= 1
            rows.write.parquet(f"{tmp_path}/d/result/batch_id=0")   # written, then the driver is lost
            raise RuntimeError("lost")
        return rows

    with pytest.raises(Exception):
        run(spark, sources["few"], fixed, tmp_path / "d", answer)
    made = run(spark, sources["few"], fixed, tmp_path / "d", answer).collect()
    shot = run(spark, sources["few"], fixed, tmp_path / "s")
    scored = shot.withColumn("raw_p", F.coalesce("bank_route_success_rate_15m", F.lit(0.5))).withColumn("p", F.round("raw_p", 2))
    want = {r.txn_id: r.route_id for r in policy_argmax(scored, "p", "raw_p").collect()}
    assert len(made) == len(want) == a.count() and {r.txn_id: r.route_id for r in made} == want
    sizes = {r.txn_id: r["count"] for r in shot.groupBy("txn_id").count().collect()}
    assert all(len(r.candidates) == sizes[r.txn_id] for r in made)
    # the pending table, as a stream, closed by the outcomes
    o = SS.write_time_ordered(SS.outcomes(a), f"{tmp_path}/o", "outcome_ts", 2, 2, 86400)
    from routewise.streaming.runner import run_available_now
    pending = SV.read_pending(spark, f"{tmp_path}/d")
    clock = a.agg((F.max("ts") + F.make_dt_interval(days=F.lit(20))).alias("t")).first()[0]
    spark.createDataFrame([(None, clock, None, None, None, None)], SV.PENDING).write.parquet(f"{tmp_path}/d/result/batch_id=99")
    closed, _ = run_available_now(spark, SF.close_decisions(pending, SS.read_outcomes(spark, o)), "c", output_mode="append", path=f"{tmp_path}/c")
    kinds = {}
    for r in closed.collect():
        kinds.setdefault(r.closed, set()).add(r.txn_id)
    late = {r.txn_id for r in a.where(F.col("latency_ms").cast("int") > 60).collect()}
    assert kinds.get("expired", set()) == late == kinds.get("orphan", set())
    assert kinds["matched"] == set(want) - late


def test_rows_of_one_key_against_plain_loops():
    """Windows, active rates, last events, amounts and flags under random delays, over random micro-batches."""
    rng = np.random.default_rng(3)
    late, ttl = 3, 30
    for scope in ("route", "bank", "bank_route", "global"):
        events = [(int(t), int(t + rng.integers(0, late + 1)), int(rng.random() < .6)) for t in np.sort(rng.choice(400, 150)) for _ in range(rng.integers(1, 3))]
        kept, evaluated, flags = pd.DataFrame({"part": []}), None, set()
        for low in range(0, 400, 23):
            high = low + 22
            new = [e for e in events if low <= e[1] <= high]
            if not new:
                continue
            high = max(e[1] for e in new) if max(e[1] for e in new) > (evaluated or 0) else high
            m = sorted({int(x) for x in rng.integers(low, high + 1, 6)})
            cells = pd.DataFrame([("cell", t, a, 1.0, float(k), 2.0, 5.0) for t, a, k in new], columns=["part", "tick", "arrived", "n", "k", "latency", "amount"])
            amounts = cells.assign(part="amount") if scope == "bank" else cells.iloc[:0]
            rows = pd.concat([kept, cells, amounts, pd.DataFrame({"part": "probe", "tick": m})], ignore_index=True)
            for c in ("arrived", "n", "k", "latency", "amount"):
                rows[c] = rows.get(c, np.nan)
            found = pd.concat([x for x in ST.advance_key(scope, rows, high, evaluated, late, ttl) if len(x)], ignore_index=True)
            got = found[found.part == "answer"].set_index("tick")
            for x in m:
                seen = [e for e in events if e[1] < x and e[1] <= high]
                w5 = [e for e in seen if x - 5 <= e[0]]
                if scope == "global":
                    assert got.n5[x] == sum(e[0] == x - 1 for e in seen)
                    continue
                assert got.n5[x] == len(w5) and got.k5[x] == sum(e[2] for e in w5) and got.n15[x] == sum(x - 15 <= e[0] for e in seen)
                if scope in ST.ACTIVE:
                    last = sorted({e[0] for e in seen})[-ST.ACTIVE[scope]:]
                    mine = [e[2] for e in seen if e[0] in last]
                    want = 1 - sum(mine) / len(mine) if mine else np.nan
                    assert got.active_rate[x] == pytest.approx(want, nan_ok=True)
                if scope == "bank_route":
                    good = [e[0] for e in seen if e[2]]
                    assert got["last"][x] == max(good) if good else np.isnan(got["last"][x])
                if scope == "bank":
                    assert np.isnan(got["mean"][x]) != any(e[0] < x and e[1] <= high for e in events) or got["mean"][x] == 5.0
            if scope == "route":
                for x in range((evaluated if evaluated is not None else -10) + 1, high + 1):
                    w5 = [e[2] for e in events if e[1] < x and x - 5 <= e[0]]
                    if w5 and sum(w5) / len(w5) < C.FLAG_DOWN_THRESHOLD:
                        flags.add(x)
                for x in m:
                    earlier = [f for f in flags if f < x]
                    assert got["last"][x] == max(earlier) if earlier else np.isnan(got["last"][x])
            evaluated = high
            kept = found[~found.part.isin(["answer", "evicted"])]
            assert len(kept) < 260     # bounded, however long the stream


def test_a_decision_delivered_again_in_a_later_batch_counts_once(spark, tmp_path):
    from routewise.operators.features import scope_cells, txn_order_features
    a = read_attempts(spark, SF_TINY, HOUR, with_ts=True).where("tick < 48")
    d = SS.decisions(a)
    path = str(tmp_path / "in")
    cut = d.withColumn("slice", F.floor(F.col("tick") / 12)).select("slice", *d.columns)
    again = cut.where("txn_id % 5 = 0").withColumn("slice", F.col("slice") + 1)      # the same event in the next micro-batch
    SS.write_slices(cut.unionByName(again), path)
    stream = SS.read_decisions(spark, path, 1)
    got = {r.txn_id: r.amount_to_bank_avg_ratio for r in SF.run_bank_amount(spark, stream, 16, f"{tmp_path}/a").collect()}
    want = {r.txn_id: r.amount_to_bank_avg_ratio for r in txn_order_features(a.drop("ts"), scope_cells(a.drop("ts"))).collect()}
    assert set(got) == set(want)
    assert all((v is None and got[k] is None) or abs(v - got[k]) < 1e-9 for k, v in want.items())
    rows = SF.run_ingress_meter(spark, stream, f"{tmp_path}/m").collect()
    assert len(rows) == len({r.txn_id for r in rows}) == a.count()


def test_meter_counts_completed_seconds_only(spark):
    at = lambda k, s: (k, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}.5")
    rows = [at(1, 0), at(2, 0), at(3, 1), at(4, 60), at(5, 61), at(None, 62)]
    df = spark.createDataFrame(rows, "txn_id long, t string").select("txn_id", F.to_timestamp("t").alias("decision_ts"))
    nothing = spark.createDataFrame([], SF.METER_STATE)
    out, after = SF.meter_batch(df, nothing)
    assert {r.txn_id: round(r.system_tps * 60) for r in out.collect()} == {1: 0, 2: 0, 3: 2, 4: 3, 5: 2}
    out, _ = SF.meter_batch(df.where("false").unionByName(df.where("txn_id = 5").withColumn("txn_id", F.lit(6).cast("long"))), after)
    assert [(r.txn_id, round(r.system_tps * 60)) for r in out.collect()] == [(6, 2)]


def test_incidents_over_many_ticks_in_one_batch(spark):
    """A catch-up over 28 days at minute ticks: one row per route and tick, in time that follows their number."""
    import time
    cells = spark.range(40_000).select(F.lit("R1").alias("route_id"), F.col("id").alias("tick"), F.lit(1).cast("long").alias("n"),
                                       F.when(F.col("id") % 100 < 10, 0).otherwise(1).cast("long").alias("k"))
    start = time.time()
    rows, state = SF.incident_batch(cells, None)
    got = {r.tick: (r.route_flagged_down, r.time_since_last_failure) for r in rows.collect()}
    assert len(got) == 40_000 and time.time() - start < 60
    want, last = {}, None
    for t in range(40_000):
        w = [0 if s % 100 < 10 else 1 for s in range(max(0, t - 5), t)]
        down = bool(w) and sum(w) / len(w) < 0.7
        want[t] = (float(down), float(t - last) if last is not None else 9999.0)
        last = t if down else last
    assert got == want and state.first().next_tick == 40_000


def test_a_slice_of_many_files_is_one_micro_batch(spark, tmp_path):
    """Every slice has as many files as asked for, empty ones included, and its micro-batch takes them all."""
    import os
    from routewise.streaming.runner import drain
    df = spark.range(400).select(F.lit("request").alias("kind"), F.col("id").alias("txn_id"), F.expr("if(id < 399, id div 200, 7)").alias("slice"))
    path = SS.write_slices(df, str(tmp_path / "a"), 4)
    for n in (0, 1, 7):
        assert sum(f.endswith(".parquet") for f in os.listdir(f"{path}/slice={n}")) == 4
    assert sum(f.startswith("part-none") for f in os.listdir(f"{path}/slice=7")) == 3   # one row
    got, progress = drain(spark, SS.read_arrivals(spark, path), "arrivals", SS.ARRIVAL_SCHEMA, path=str(tmp_path / "s"))
    seen = {(r.batch_id, r.slice): r["count"] for r in got.groupBy("batch_id", "slice").count().collect()}
    assert seen == {(0, 0): 200, (1, 1): 199, (2, 7): 1} and got.select("txn_id").distinct().count() == 400


def test_candidates_of_a_decision_are_scored_once(spark, fixed):
    """Choice and list of candidates come from one aggregate of the scored snapshot."""
    import contextlib
    import io

    class Model:
        def transform(self, df):
            from pyspark.ml.functions import array_to_vector
            return df.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))

    class Calibrator:
        def transform(self, df):
            return df.withColumn("p", F.col("raw_p") + F.lit(0.125))

    rows = [(1, 0, "R1"), (1, 1, "R2"), (None, 0, "R1")]
    shot = spark.createDataFrame(rows, "txn_id long, route_order int, route_id string")
    requests = spark.createDataFrame([(1, "HDFC", "Visa"), (None, "SBI", "UPI")], "txn_id long, bank string, network string").withColumn("arrival_ts", F.current_timestamp())
    made, plan = SV.decide(Model(), Calibrator())(requests, None, shot), io.StringIO()
    with contextlib.redirect_stdout(plan):
        made.explain()
    assert [(r.txn_id, r.route_id, r.chosen_p, len(r.candidates)) for r in made.collect()] == [(1, "R1", 0.625, 2)]
    assert plan.getvalue().count("0.125") == 1


def test_meter_windows_reach_over_block_borders_without_sixtyfold_rows(spark):
    """Counts of the 60 seconds before, across the borders of the meter's blocks, against plain loops."""
    seconds = [s for s in range(500, 1900, 7) for _ in range(1 + s % 3)] + [1199, 1200, 1259, 1260, 1261]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "txn_id long, s long").select(
        "txn_id", F.timestamp_seconds("s").alias("decision_ts"))
    out, after = SF.meter_batch(df, spark.createDataFrame([(480, 4), (460, 1)], SF.METER_STATE))
    every = seconds + [480] * 4 + [460]
    want = {i: sum(s - 60 <= x < s for x in every) for i, s in enumerate(seconds)}
    assert {r.txn_id: round(r.system_tps * 60) for r in out.collect()} == want
    assert {r.second: r.n for r in after.collect()} == {s: every.count(s) for s in set(every) if s >= max(every) - 60}
    assert "sequence(" not in out._jdf.queryExecution().toString()


def test_the_meter_writes_no_stream_of_outcomes(spark, monkeypatch):
    """A query that reads one of the two streams does not derive and write the other."""
    from routewise.plans.catalog import QUERIES
    written = []
    monkeypatch.setattr(SS, "write_time_ordered", lambda df, path, *a: written.append(path) or path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):   # nothing was written, so the stream finds no folder
        QUERIES["stream_ingress_meter"](spark, SF_TINY)
    assert len(written) == 1 and written[0].endswith("/decisions")
