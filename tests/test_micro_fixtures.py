"""Hand-computed micro-fixtures for the window semantics (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.functions.exprs import day_in_week, hour_of_day
from routewise.operators.timeline import prior_rolling_sum


def approx(a, b):
    return a is None and b is None or (a is not None and b is not None and abs(a - b) < 1e-6)


def cells_df(spark, rows, cols="route_id string, tick long, request_count long, success_count long, latency_sum double"):
    return spark.createDataFrame(rows, cols)


def test_w1_prior_rolling_sum(spark):
    df = spark.createDataFrame([("g", t, float(t + 1)) for t in range(7)], "g string, tick long, v double")
    out = df.select("tick", prior_rolling_sum("v", ["g"], 5).alias("s")).orderBy("tick").collect()
    assert [r.s for r in out] == [0, 1, 3, 6, 10, 15, 20]


def _route_cells(spark, succ):
    from routewise.operators.features import route_state
    rows = [("route", None, "R1", None, t, None, 10, s, 10.0 * 10, None, 10 - s, float(10 - s))
            for t, s in enumerate(succ)]
    cells = spark.createDataFrame(
        rows, "scope string, bank string, route_id string, network string, tick long, block long, "
              "request_count long, success_count long, latency_sum double, last_success_tick long, "
              "failure_count long, amount_sum double")
    glob = cells.withColumn("scope", F.lit("global")).withColumn("route_id", F.lit(None).cast("string"))
    return route_state(cells.unionByName(glob), 60, F.lit(len(succ)).cast("long"))


def test_w2_w5_w6_rates_flags_incidents(spark):
    st = _route_cells(spark, [10, 0, 0, 10, 10, 10, 10, 10, 10])
    r = {x.tick: x for x in st.where("is_active").collect()}
    rates = [r[t].route_success_rate_5m for t in range(9)]
    exp = [None, 1, .5, 1 / 3, .5, .6, .6, .8, 1]
    assert all(approx(a, b) for a, b in zip(rates, exp))
    assert [r[t].route_flagged_down for t in range(9)] == [0, 0, 1, 1, 1, 1, 1, 0, 0]
    assert [r[t].time_since_last_failure for t in range(9)] == [9999, 9999, 9999, 1, 1, 1, 1, 1, 2]


def test_w23_incident_episode(spark):
    from routewise.operators.evaluate import incident_episodes
    st = _route_cells(spark, [10, 0, 0, 10, 10, 10, 10, 10, 10])
    ep = incident_episodes(st).collect()
    assert [(e.start_tick, e.end_tick, e.duration) for e in ep] == [(2, 6, 5)]


def test_w7_time_since_any_failure(spark):
    from routewise.operators.timeline import last_before
    df = cells_df(spark, [("R1", t, 10, s, 0.0) for t, s in enumerate([10, 0, 0, 10, 10, 10, 10, 10, 10])])
    df = df.withColumn("failure_count", F.col("request_count") - F.col("success_count"))
    last = last_before(F.when(F.col("failure_count") > 0, F.col("tick")), ["route_id"])
    out = df.select("tick", F.coalesce((F.col("tick") - last).cast("double"), F.lit(9999.0)).alias("x")) \
        .orderBy("tick").collect()
    assert [r.x for r in out] == [9999, 9999, 1, 1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("mode,expected", [("active", [None, 1 / 2, 1 / 3, 3 / 5]),
                                           ("clock", [None, 1 / 2, None, 1.0])])
def test_w9_active_rows_vs_clock(spark, mode, expected):
    from routewise.operators.features import active_failure_rate
    rows = [("bank", "B", None, None, t, None, n, n - f, 0.0, None, f, 0.0)
            for t, f, n in [(0, 1, 2), (1, 0, 1), (10, 2, 2), (11, 0, 3)]]
    cells = spark.createDataFrame(
        rows, "scope string, bank string, route_id string, network string, tick long, block long, "
              "request_count long, success_count long, latency_sum double, last_success_tick long, "
              "failure_count long, amount_sum double")
    out = active_failure_rate(cells, "bank", "bank", "r", mode=mode).orderBy("tick").collect()
    assert all(approx(a.r, b) for a, b in zip(out, expected))


def test_w11_previous_active_row(spark):
    from routewise.operators.features import route_state
    rows = [("route", None, "R1", None, t, None, n, n - f, 0.0, None, f, 0.0)
            for t, f, n in [(0, 1, 2), (1, 0, 1), (10, 2, 2), (11, 0, 3)]]
    cells = spark.createDataFrame(
        rows, "scope string, bank string, route_id string, network string, tick long, block long, "
              "request_count long, success_count long, latency_sum double, last_success_tick long, "
              "failure_count long, amount_sum double")
    st = route_state(cells, 60, F.lit(12).cast("long")).where("is_active").orderBy("tick").collect()
    assert all(approx(a.route_failure_rate_1m, b) for a, b in zip(st, [None, 0.5, 0.0, 1.0]))


def test_w8_shrinkage():
    prior, k = 0.95, C.BANK_ROUTE_SHRINK_K
    assert abs((3 + k * prior) / (4 + k) - 0.892857) < 1e-6
    assert abs((0 + k * prior) / (0 + k) - 0.95) < 1e-12


def _attempts(spark, rows):
    return spark.createDataFrame(
        [(t, m, a, "B", "UPI", "UPI", "Food", "Web", "LOW", "R1", s, 1.0) for t, m, s, a in rows],
        "txn_id long, tick long, amount double, bank string, network string, payment_method string, "
        "merchant string, device string, risk string, route_id string, success int, latency_ms double")


@pytest.mark.parametrize("block_size", [1 << 20, 2, 3])
def test_w12_w13_blocked_prefix(spark, block_size):
    from routewise.operators.features import scope_cells, txn_order_features
    a = _attempts(spark, [(1, 0, 0, 100.0), (2, 0, 1, 300.0), (3, 0, 0, 50.0), (4, 5, 1, 1.0), (5, 9, 0, 1.0)])
    cells = scope_cells(a, block_size)
    out = {r.txn_id: r for r in txn_order_features(a, cells, block_size).collect()}
    assert [out[i].time_since_last_bank_route_success for i in range(1, 6)] == [9999, 9999, 0, 5, 4]
    assert out[1].amount_to_bank_avg_ratio is None
    assert approx(out[2].amount_to_bank_avg_ratio, 3.0)
    assert approx(out[3].amount_to_bank_avg_ratio, 0.25)


def test_w15_round_robin(spark):
    from routewise.operators.policy import policy_round_robin
    nets = ["Mastercard", "Visa", "Mastercard", "Rupay", "Visa", "Mastercard"]
    order = {"R1": 0, "R2": 1, "R3": 2, "R4": 3}
    elig = {r[0]: set(r[5]) for r in C.ROUTES}
    rows = [(i, rid, order[rid]) for i, n in enumerate(nets) for rid in C.ROUTE_IDS if n in elig[rid]]
    cands = spark.createDataFrame(rows, "txn_id long, route_id string, route_order int")
    for bs, group in ((1 << 20, 1 << 12), (2, 2), (1, 2), (4, 1)):
        got = {r.txn_id: r.route_id for r in policy_round_robin(cands, bs, group).collect()}
        assert [got[i] for i in range(6)] == ["R1", "R2", "R3", "R4", "R1", "R3"]


def test_g15_cost(spark):
    from routewise.operators.evaluate import cost_at_threshold
    # FN, FP, TN, TP at threshold 0.5 (failure predicted when 1 - p >= 0.5)
    df = spark.createDataFrame([(0.9, 0), (0.1, 1), (0.9, 1), (0.1, 0)],
                               "p double, success int").withColumn("amount", F.lit(1000.0)) \
        .withColumn("route_cost_percent", F.lit(2.0))
    r = cost_at_threshold(df, 0.5).first()
    assert approx(r.total_cost, 70.0) and approx(r.cost_per_txn, 17.5)


@pytest.mark.parametrize("parity,bins", [(False, [0, 1, 9]), (True, [0, 1])])
def test_g11_calibration_bins(spark, parity, bins):
    from routewise.operators.evaluate import calibration_bins
    df = spark.createDataFrame([(0.05, 1), (0.15, 0), (1.0, 1)], "p double, success int")
    assert sorted(r.bin for r in calibration_bins(df, parity=parity).collect()) == bins


def test_p13_amount_bands(spark):
    from routewise.functions.exprs import amount_band
    df = spark.createDataFrame([(a,) for a in (10.0, 99.99, 100.0, 1000.0, 9999.0, 10000.0)], "a double")
    assert [r[0] for r in df.select(amount_band(F.col("a"))).collect()] == [0, 0, 1, 2, 2, 3]


def test_p1_time_features(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1439, 1440, 10080)], "tick long")
    out = df.select(day_in_week(F.col("tick"), 60).alias("d"), hour_of_day(F.col("tick"), 60).alias("h")).collect()
    assert [(r.d, r.h) for r in out] == [(0, 0), (0, 23), (1, 0), (0, 0)]
