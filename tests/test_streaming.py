"""Batch == stream on the tiny fixture after an availableNow drain."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY

from routewise.plans.context import Ctx


@pytest.fixture(scope="module")
def ctx(spark):
    return Ctx(spark, SF_TINY)


def test_stream_stream_join_equals_batch(spark, ctx):
    from routewise.plans.catalog import QUERIES
    s = {(r.txn_id, r.route_id, r.success) for r in QUERIES["stream_decision_outcome"](spark, SF_TINY).collect()}
    b = {(r.txn_id, r.route_id, r.success) for r in QUERIES["decision_outcome_join"](spark, SF_TINY).collect()}
    assert s == b and len(s) > 0


def test_dedup_outcomes(spark):
    from routewise.plans.catalog import QUERIES
    rows = QUERIES["stream_dedup_outcomes"](spark, SF_TINY).collect()
    ids = [r.txn_id for r in rows]
    assert len(ids) == len(set(ids)) == Ctx(spark, SF_TINY).attempts.count()


@pytest.fixture(scope="module")
def minutes(spark):
    """60 hours of attempts at minute ticks, replayed in batches shorter than a callback may take."""
    from routewise.sources import read_attempts
    from routewise.streaming import sources as SS
    a = read_attempts(spark, SF_TINY, 60, with_ts=True).where("tick < 3600")
    return a, SS.materialise_streams(spark, a, batches=40, files=1)


def test_short_batches_lose_no_late_outcome(spark, minutes):
    from routewise.operators.timeline import minute_table
    from routewise.streaming import features as SF
    from routewise.streaming import sources as SS
    from routewise.streaming.runner import dropped_by_watermark, run_available_now
    a, (_, path) = minutes
    res, progress = run_available_now(spark, SF.rolling_rates(SS.read_outcomes(spark, path, 1), 60), "t", keys=["route_id", "tick"])
    assert len(progress) >= 40 and dropped_by_watermark(progress) == 0
    cells = {(r.route_id, r.tick): (r.request_count, r.success_count) for r in minute_table(a, ["route_id"]).collect()}
    want = {}
    for (route, tick), (n, k) in cells.items():
        for off in range(1, 16):
            x = want.setdefault((route, tick + off), [0, 0, 0, 0])
            x[0] += n
            x[1] += k
            if off <= 5:
                x[2] += n
                x[3] += k
    got = {(r.route_id, r.tick): r for r in res.collect()}
    assert set(got) == set(want)
    for key, (n15, k15, n5, k5) in want.items():
        r = got[key]
        assert abs(r.route_success_rate_15m - k15 / n15) < 1e-9
        assert (r.route_success_rate_5m is None) == (n5 == 0)
        assert not n5 or abs(r.route_success_rate_5m - k5 / n5) < 1e-9


def test_stopped_and_restarted_run_equals_an_unbroken_one(spark, minutes, tmp_path):
    """The path is stable: a second call goes on, and a micro-batch run again replaces its first try."""
    import shutil
    from routewise.streaming import features as SF
    from routewise.streaming import sources as SS
    from routewise.streaming.runner import drain
    _, (path, _) = minutes
    stream = SF.watermarked(SS.read_decisions(spark, path, 4), "decision_ts").select("txn_id", "amount")
    state = {"fail": True}

    def per_batch(batch, batch_id, out):
        if batch_id == 3 and state["fail"]:
            state["fail"] = False
            batch.write.parquet(f"{out}/batch_id={batch_id}")   # written, then the driver is lost
            raise RuntimeError("lost")
        return batch

    with pytest.raises(Exception):
        drain(spark, stream, "x", stream.schema, per_batch=per_batch, path=str(tmp_path / "s"))
    res, _ = drain(spark, stream, "x", stream.schema, per_batch=per_batch, path=str(tmp_path / "s"))
    whole, _ = drain(spark, stream, "x", stream.schema, path=str(tmp_path / "w"))
    assert sorted(res.select("txn_id").collect()) == sorted(whole.select("txn_id").collect())
    again, progress = drain(spark, stream, "x", stream.schema, path=str(tmp_path / "w"))
    assert again.count() == whole.count()
    shutil.rmtree(tmp_path)


def test_bank_amounts_over_many_batches_equal_batch(spark, minutes):
    from routewise.operators.features import scope_cells, txn_order_features
    from routewise.streaming import features as SF
    from routewise.streaming import sources as SS
    a, (path, _) = minutes
    got = {r.txn_id: r.amount_to_bank_avg_ratio for r in
           SF.run_bank_amount(spark, SS.read_decisions(spark, path, 8), 16).collect()}
    want = {r.txn_id: r.amount_to_bank_avg_ratio for r in txn_order_features(a.drop("ts"), scope_cells(a)).collect()}
    assert set(got) == set(want)
    assert all((v is None and got[k] is None) or abs(v - got[k]) < 1e-6 for k, v in want.items())


def test_incidents_over_many_batches_equal_batch(spark, minutes):
    from routewise.operators.features import build_state
    from routewise.sources import route_dim
    from routewise.streaming import features as SF
    from routewise.streaming import sources as SS
    a, (_, path) = minutes
    got = {(r.route_id, r.tick): (r.route_flagged_down, r.time_since_last_failure) for r in
           SF.run_incident_state(spark, SS.read_outcomes(spark, path, 8), 60).collect()}
    st = build_state(a.drop("ts"), route_dim(spark), 60)
    want = {(r.route_id, r.tick): (r.route_flagged_down, r.time_since_last_failure)
            for r in st.route.where("is_active").collect()}
    assert set(want) <= set(got) and all(got[k] == v for k, v in want.items())
