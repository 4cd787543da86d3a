"""Property tests: causality, dense == semi-dense spine, block-size invariance,
ordered prefix and split boundary against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY

from routewise.operators.features import build_state, feature_table, scope_cells, txn_order_features
from routewise.sources import read_attempts, route_dim


@pytest.fixture(scope="module")
def attempts(spark):
    return read_attempts(spark, SF_TINY).cache()


def test_block_size_invariance(spark, attempts):
    a = txn_order_features(attempts, scope_cells(attempts, 1 << 20), 1 << 20).select(
        "txn_id", "time_since_last_bank_route_success", "amount_to_bank_avg_ratio")
    b = txn_order_features(attempts, scope_cells(attempts, 37), 37).select(
        "txn_id", "time_since_last_bank_route_success", "amount_to_bank_avg_ratio")
    ra = {r.txn_id: (r[1], None if r[2] is None else round(r[2], 9)) for r in a.collect()}
    rb = {r.txn_id: (r[1], None if r[2] is None else round(r[2], 9)) for r in b.collect()}
    assert ra == rb and len(ra) == attempts.count()


def test_causality_future_changes_do_not_leak(spark, attempts):
    """Flipping outcomes at ticks >= m must not change any feature at ticks < m
    (nor the row's own success for W12/W13 of that row)."""
    m = 600   # beyond the training horizon (540), so the training priors are unchanged
    flipped = attempts.withColumn("success", F.when(F.col("tick") >= m, 1 - F.col("success")).otherwise(F.col("success")))
    cols = ["txn_id", "route_success_rate_5m", "route_success_rate_15m", "time_since_last_failure",
            "bank_route_success_rate_15m", "bank_failure_rate_5m", "network_failure_rate_5m",
            "route_failure_rate_1m", "time_since_last_bank_route_success", "amount_to_bank_avg_ratio"]

    def feats(df):
        st = build_state(df, route_dim(spark))
        return {r.txn_id: tuple(r[1:]) for r in feature_table(df, st, engineered=True).where(F.col("tick") < m)
                .select(*cols).collect()}

    base, new = feats(attempts), feats(flipped)
    assert base == new


def test_dense_equals_semi_dense(spark, attempts):
    """time_since_last_failure on the semi-dense spine equals a dense brute force."""
    st = build_state(attempts, route_dim(spark))
    got = {(r.route_id, r.tick): r.time_since_last_failure
           for r in st.route.where("is_active").select("route_id", "tick", "time_since_last_failure").collect()}
    pdf = attempts.groupBy("route_id", "tick").agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("k")).toPandas()
    total = int(attempts.agg(F.max("tick")).first()[0]) + 1
    for rid, g in pdf.groupby("route_id"):
        n = np.zeros(total)
        k = np.zeros(total)
        n[g.tick.to_numpy()] = g.n.to_numpy()
        k[g.tick.to_numpy()] = g.k.to_numpy()
        last = None
        for t in range(total):
            n5, k5 = n[max(0, t - 5):t].sum(), k[max(0, t - 5):t].sum()
            since = 9999.0 if last is None else float(t - last)
            if (rid, t) in got:
                assert got[(rid, t)] == since, (rid, t)
            if n5 > 0 and k5 / n5 < 0.7:
                last = t


def test_ordered_prefix_and_position(spark):
    from routewise.operators.prefix import global_position, ordered_prefix
    rng = np.random.default_rng(3)
    s = np.round(rng.random(500), 3)
    df = spark.createDataFrame([(float(x), int(i % 2)) for i, x in enumerate(s)], "s double, y int")
    cum = {r.s: r.cum_y for r in ordered_prefix(df, "s", ["y"], ranges=16).collect()}
    ys = np.array([i % 2 for i in range(500)])
    for v, c in cum.items():
        assert c == ys[s <= v].sum()
    pos_df = spark.createDataFrame([(int(t), int(i)) for i, t in enumerate(rng.integers(0, 20, 300))],
                                   "tick long, txn_id long")
    got = {r.txn_id: r.position for r in global_position(pos_df, "tick", "txn_id", block_size=7).collect()}
    exp = sorted(((r.tick, r.txn_id) for r in pos_df.collect()))
    assert all(got[x] == i for i, (_, x) in enumerate(exp))


def test_split_boundary_block_invariance(spark, attempts):
    from routewise.operators.evaluate import split_three
    f = attempts.withColumn("dataset_split", F.when(F.col("tick") < 540, "train").otherwise("test"))
    a = {r.txn_id: r.split3 for r in split_three(f, 1 << 20, attempts, F.lit(540)).collect()}
    b = {r.txn_id: r.split3 for r in split_three(f, 5, attempts, F.lit(540)).collect()}
    assert a == b
    train = sorted((r.tick, r.txn_id) for r in f.where("dataset_split = 'train'").collect())
    cut = int(len(train) * 0.8)
    assert all(a[x] == ("train" if i < cut else "validation") for i, (_, x) in enumerate(train))


def test_binding_is_time_zone_independent(spark):
    """Ticks come from the UTC wall clock whatever the session time zone is."""
    from conftest import SF_TINY as sf
    utc = {r.txn_id: r.tick for r in read_attempts(spark, sf).select("txn_id", "tick").collect()}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        ist = {r.txn_id: r.tick for r in read_attempts(spark, sf).select("txn_id", "tick").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == ist and min(utc.values()) == 0
