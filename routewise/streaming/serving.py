"""ST11/ST12: features from the streams' own state, routing decision by the saved model.

Each micro-batch of arrivals is joined with the state of the micro-batch before it
(:mod:`routewise.streaming.state`).  A request of tick m is expanded to its eligible routes and reads what
had arrived before tick m; only then its own arrival counts.  The candidates are scored by a saved pipeline, the best
one is written as a pending decision in a folder named by the micro-batch, and that table is itself a
stream that outcomes close.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.functions.exprs import day_in_week, flagged_down, hour_of_day
from routewise.operators.features import add_engineered, route_capacity, route_fee, route_share
from routewise.operators.policy import argmax_route
from routewise.streaming import state as ST
from routewise.streaming.features import CALLBACK_TTL
from routewise.streaming.runner import drain

SNAPSHOT = ("txn_id", "tick", "route_order", *C.NUMERIC_FEATURES, *C.CATEGORICAL_FEATURES)


def snapshot(requests: DataFrame, state: DataFrame, eligibility: DataFrame, baselines: DataFrame, prior: float | None,
             tick_seconds: int) -> DataFrame:
    """ST11: the 26 numeric + 7 categorical inputs for every (request x eligible route).

    ``state`` holds the answers to the requests' probes.  ``baselines`` are the frozen values that a deployment
    starts with, at most one row per route.
    """
    def answers(scope: str, keys: dict[str, str], **columns: str) -> DataFrame:
        return state.where((F.col("part") == "answer") & (F.col("scope") == scope)).select(
            *[F.col(k).alias(name) for k, name in keys.items()], "tick", *[F.col(c).alias(name) for name, c in columns.items()])

    x = requests.select("txn_id", "tick", "amount", "bank", "network", "payment_method", "merchant", "device", "risk")
    x = x.join(F.broadcast(eligibility), ["payment_method", "network"])
    x = x.join(answers("route", {"k1": "route_id"}, n5="n5", k5="k5", l5="latency5", n15="n15", k15="k15", flagged="last",
                       route_failure_rate_1m="active_rate"), ["route_id", "tick"], "left")
    x = x.join(answers("bank", {"k1": "bank"}, bank_failure_rate_5m="active_rate", mean="mean"), ["bank", "tick"], "left")
    x = x.join(answers("network", {"k1": "network"}, network_failure_rate_5m="active_rate"), ["network", "tick"], "left")
    x = x.join(answers("bank_route", {"k1": "bank", "k2": "route_id"}, bn="n15", bk="k15", success_tick="last"),
               ["bank", "route_id", "tick"], "left")
    x = x.join(answers("global", {}, load="n5"), "tick", "left").join(F.broadcast(baselines), "route_id", "left")
    c = F.col
    rate = lambda k, n: F.when(c(n) > 0, c(k) / c(n))
    since = lambda at: F.coalesce(c("tick") - c(at), F.lit(C.NO_EVENT_SENTINEL))
    count = lambda n: F.coalesce(c(n), F.lit(0.0))
    base, tps = F.coalesce("route_base_success_rate", F.lit(prior).cast("double")), count("load") / F.lit(float(tick_seconds))
    x = x.withColumns({
        "day_in_week": day_in_week(c("tick"), tick_seconds), "hour_of_day": hour_of_day(c("tick"), tick_seconds),
        "route_cost_percent": route_fee(c("route_id")), "route_success_rate_5m": rate("k5", "n5"),
        "route_success_rate_15m": rate("k15", "n15"), "route_avg_latency_5m": rate("l5", "n5"), "route_flagged_down": flagged_down(rate("k5", "n5")),
        "time_since_last_failure": since("flagged"), "time_since_last_bank_route_success": since("success_tick"), "system_tps": tps,
        "route_utilization": tps * route_share(c("route_id")) / route_capacity(c("route_id")),
        "bank_route_success_rate_15m": (count("bk") + C.BANK_ROUTE_SHRINK_K * base) / (count("bn") + C.BANK_ROUTE_SHRINK_K),
        "amount_to_bank_avg_ratio": F.when(c("mean") > 0, c("amount") / c("mean"))})
    return add_engineered(x).select(*SNAPSHOT)


Answer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def serve(spark: SparkSession, arrivals: DataFrame, eligibility: DataFrame, baselines: DataFrame, prior: float | None,
          tick_seconds: int, path: str, answer: Answer | None = None, ttl_ticks: int = ST.BUCKET_TTL_TICKS,
          delay: int = CALLBACK_TTL) -> DataFrame:
    """Answer every micro-batch of arrivals from the state before it; the rows of all answers with ``batch_id``.

    ``answer`` makes a micro-batch's rows of its requests, the state table and their snapshot (the snapshot itself by
    default).  Under ``path`` lie result and state, one folder per micro-batch, and the checkpoint: called again with
    the same path, serving goes on where it ended.  Redelivered events are removed by the stream within ``delay``.
    """
    late = ST.late_ticks(delay, tick_seconds)
    events = arrivals.withWatermark("arrival_ts", f"{delay} seconds").dropDuplicatesWithinWatermark(["kind", "txn_id"])
    routes = list(C.ROUTE_IDS)

    def rows_of(batch: DataFrame, state: DataFrame) -> DataFrame:
        requests = batch.where("kind = 'request'")
        shot = snapshot(requests, state, eligibility, baselines, prior, tick_seconds)
        return answer(requests, state, shot) if answer else shot

    schema = rows_of(spark.createDataFrame([], events.schema), ST.read_state(spark, path, -1)).schema

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        own = batch.sparkSession
        before = ST.read_state(own, path, batch_id - 1)
        clock = before.where("part = 'clock'").select("tick").first()
        clock = clock["tick"] if clock else None
        high = batch.agg(F.max("arrived")).first()[0]
        if high is None:    # nothing arrived: the state stays as it is
            before.where("part not in ('answer', 'evicted')").write.mode("overwrite").parquet(f"{path}/state/{batch_id}")
            return spark.createDataFrame([], schema)
        high = max(high, clock) if clock is not None else high
        after = ST.advanced(before if clock is not None else None, clock, batch, routes, high, late, ttl_ticks)
        after.write.mode("overwrite").parquet(f"{path}/state/{batch_id}")
        ST.drop_state(spark, path, batch_id - 2)
        return rows_of(batch, ST.read_state(own, path, batch_id))

    return drain(spark, events, "serve", schema, per_batch=per_batch, path=path)[0]


def decide(model, calibrator) -> Answer:
    """ST12: the pending decision of every request, by the calibrated score (ties: raw score, then route order)."""
    from routewise.operators.learn import score

    def answer(requests: DataFrame, state: DataFrame, shot: DataFrame) -> DataFrame:
        scored = score(model, calibrator, shot)
        # one aggregate for choice and list: every candidate is scored once
        made = scored.where(F.col("txn_id").isNotNull()).groupBy("txn_id").agg(
            argmax_route("p", "raw_p").alias("best"),
            F.sort_array(F.collect_list(F.struct("route_id", F.col("p").alias("predicted_success_probability")))).alias("candidates"))
        asked = requests.select("txn_id", F.col("arrival_ts").alias("decision_ts"), "bank", "network")
        return asked.join(made, "txn_id").select(
            "txn_id", "decision_ts", "bank", "network", "best.route_id", F.col("best.score").alias("chosen_p"), "candidates")

    return answer


PENDING = "txn_id long, decision_ts timestamp, bank string, network string, route_id string, chosen_p double"


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """The pending decisions under a serving path as a stream, in the order of the micro-batches."""
    return spark.readStream.schema(PENDING).parquet(f"{path}/result/batch_id=*")
