"""Streaming feature maintenance (ST1-ST10) on decision / outcome streams.

Event time is the attempt time (late callbacks are credited to the attempt tick).  Every watermark waits
``CALLBACK_TTL`` seconds, the longest time a callback may take, whatever the tick: state lives as long as
a row for it may still come.  Ticks are ``tick_seconds`` long and aligned to 2024-01-01 00:00 UTC, so a
tumbling window of one tick starts exactly at the batch tick boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routewise import constants as C
from routewise.operators.prefix import block_of, block_prefix, in_block_window
from routewise.sources.bindings import EPOCH_2024
from routewise.sources.sinks import shared_path
from routewise.streaming.runner import drain


def tick_of(ts: Column, tick_seconds: int) -> Column:
    return F.floor((F.unix_seconds(ts) - F.lit(EPOCH_2024)) / F.lit(tick_seconds)).cast("long")


#: Seconds after its attempt within which a callback counts.
CALLBACK_TTL = 7200


def watermarked(events: DataFrame, event_col: str, delay: int = CALLBACK_TTL) -> DataFrame:
    """The events with a watermark; rows without txn_id only move the clock and go after it.

    (The condition names the event time, so that it is not pushed below the watermark.)
    """
    return (events.withWatermark(event_col, f"{delay} seconds")
            .where(F.col("txn_id").isNotNull() | F.col(event_col).isNull()))


def dedup_outcomes(outcomes: DataFrame, delay: int = CALLBACK_TTL, event_col: str = "outcome_ts") -> DataFrame:
    """ST7: idempotent outcomes -- one per attempt id within the watermark.

    The watermark is defined here once, on ``event_col``; downstream
    stateful operators reuse it (a stream carries a single watermark).
    """
    return watermarked(outcomes, event_col, delay).dropDuplicatesWithinWatermark(["txn_id"])


def minute_buckets(decisions: DataFrame, outcomes: DataFrame, tick_seconds: int, ttl_ticks: int = 30) -> DataFrame:
    """ST1 (+ST2): request / attempt / success / latency counters per scope x tick.

    Requests count at the decision tick, outcomes at their attempt tick.
    Five scopes via one explode; the watermark (``ttl_ticks`` ticks) evicts
    bucket state, as the key expiry does online.
    """
    nul = F.lit(None).cast("string")
    delay = max(ttl_ticks * tick_seconds, CALLBACK_TTL)
    d = watermarked(decisions, "decision_ts", delay).select(
        F.col("decision_ts").alias("event_ts"), "bank", "network", "route_id",
        F.lit(1).alias("req"), F.lit(0).alias("att"), F.lit(0).alias("succ"), F.lit(0.0).alias("lat"))
    o = dedup_outcomes(outcomes, delay, "attempt_ts").select(F.col("attempt_ts").alias("event_ts"), "bank", "network", "route_id",
                                        F.lit(0).alias("req"), F.lit(1).alias("att"), F.col("success").alias("succ"),
                                        F.col("latency_ms").alias("lat"))
    ev = d.unionByName(o)

    def sc(name, b, r, n):
        return F.struct(F.lit(name).alias("scope"), b.alias("bank"), r.alias("route_id"), n.alias("network"))

    scopes = F.array(sc("route", nul, F.col("route_id"), nul), sc("bank", F.col("bank"), nul, nul),
                     sc("network", nul, nul, F.col("network")),
                     sc("bank_route", F.col("bank"), F.col("route_id"), nul), sc("global", nul, nul, nul))
    x = ev.select("event_ts", "req", "att", "succ", "lat", F.explode(scopes).alias("s"))
    g = (x.groupBy("s.scope", "s.bank", "s.route_id", "s.network", F.window("event_ts", f"{tick_seconds} seconds"))
         .agg(F.sum("req").alias("requests"), F.sum("att").alias("attempts"), F.sum("succ").alias("successes"),
              F.sum("lat").alias("latency_sum")))
    return g.select("scope", "bank", "route_id", "network", tick_of(F.col("window.start"), tick_seconds).alias("tick"),
                    "requests", "attempts", "successes", "latency_sum")


def rolling_rates(outcomes: DataFrame, tick_seconds: int, delay: int = CALLBACK_TTL) -> DataFrame:
    """ST3: trailing 15-, 5- and 1-tick rates of a route, current tick excluded.

    One sliding window [m-15, m) with slide one tick; the row whose window ends at m is the feature at m.
    The shorter windows are conditional sums in the same aggregate.
    """
    o = dedup_outcomes(outcomes, delay, "attempt_ts")
    w = F.window("attempt_ts", f"{C.WINDOW_15 * tick_seconds} seconds", f"{tick_seconds} seconds")
    o = o.select("route_id", "attempt_ts", "success", "latency_ms", w.alias("w"))

    def last(ticks: int) -> Column:
        return F.col("attempt_ts") >= F.col("w.end") - F.make_dt_interval(secs=F.lit(ticks * tick_seconds))

    def within(ticks: int, value: Column) -> Column:
        return F.sum(F.when(last(ticks), value))

    g = o.groupBy("route_id", "w").agg(
        F.count(F.lit(1)).alias("n15"), F.sum("success").alias("k15"),
        F.count_if(last(C.WINDOW_5)).alias("n5"), within(C.WINDOW_5, F.col("success")).alias("k5"),
        within(C.WINDOW_5, F.col("latency_ms")).alias("lat5"), F.count_if(last(C.WINDOW_1)).alias("n1"))
    return g.select("route_id", tick_of(F.col("w.end"), tick_seconds).alias("tick"),
                    F.when(F.col("n5") > 0, F.col("k5") / F.col("n5")).alias("route_success_rate_5m"),
                    (F.col("k15") / F.col("n15")).alias("route_success_rate_15m"),
                    F.when(F.col("n5") > 0, F.col("lat5") / F.col("n5")).alias("route_avg_latency_5m"),
                    F.col("n1").cast("double").alias("route_requests_1m"))


def last_success(outcomes: DataFrame) -> DataFrame:
    """ST5: per (bank, route) the last tick with a success (update mode, bounded keys)."""
    o = dedup_outcomes(outcomes)
    return (o.where(F.col("success") == 1).groupBy("bank", "route_id")
            .agg(F.max("tick").alias("last_success_tick")))


def _pending_join(decisions: DataFrame, outcomes: DataFrame, ttl: int, how: str) -> DataFrame:
    d = watermarked(decisions, "decision_ts", ttl).alias("d")
    o = dedup_outcomes(outcomes, ttl, "outcome_ts").alias("o")
    cond = ((F.col("d.txn_id") == F.col("o.txn_id")) & (F.col("o.outcome_ts") >= F.col("d.decision_ts"))
            & (F.col("o.outcome_ts") <= F.col("d.decision_ts") + F.expr(f"INTERVAL {ttl} SECONDS")))
    return d.join(o, cond, how)


def decision_outcome_join(decisions: DataFrame, outcomes: DataFrame, ttl: int = C.PENDING_TTL_SECONDS,
                          how: str = "inner") -> DataFrame:
    """ST6: pending decision matched with its outcome within the TTL (stream-stream join).

    ``left_outer`` also gives the expired decisions, once the watermarks say that no outcome can come.
    """
    return _pending_join(decisions, outcomes, ttl, how).select(F.col("d.txn_id").alias("txn_id"), F.col("d.route_id").alias("route_id"),
                                       "d.decision_ts", "o.outcome_ts", "o.success")


def close_decisions(decisions: DataFrame, outcomes: DataFrame, ttl: int = C.PENDING_TTL_SECONDS) -> DataFrame:
    """ST6 with J14: every decision and outcome closed once, as matched, expired or orphan.

    One full outer stream-stream join: a decision without an outcome within the TTL expires, an outcome without a
    pending decision (none ever made, or one that has expired) is an orphan.
    """
    j = _pending_join(decisions, outcomes, ttl, "full_outer")
    kind = F.when(F.col("o.txn_id").isNull(), "expired").when(F.col("d.txn_id").isNull(), "orphan").otherwise("matched")
    return j.select(F.coalesce("d.txn_id", "o.txn_id").alias("txn_id"), kind.alias("closed"),
                    F.coalesce("d.route_id", "o.route_id").alias("route_id"), "d.decision_ts", "o.outcome_ts", "o.success")


def late_credit(outcomes: DataFrame, tick_seconds: int, delay: int = CALLBACK_TTL) -> DataFrame:
    """ST8: outcomes credited to their attempt tick; rows later than the watermark are dropped (and counted)."""
    g = (dedup_outcomes(outcomes, delay, "attempt_ts")
         .groupBy(F.window("attempt_ts", f"{tick_seconds} seconds"))
         .agg(F.count(F.lit(1)).alias("outcomes"), F.sum("success").alias("successes")))
    return g.select(tick_of(F.col("window.start"), tick_seconds).alias("tick"), "outcomes", "successes")


def system_tps(decisions: DataFrame, tick_seconds: int, delay: int = CALLBACK_TTL) -> DataFrame:
    """ST10: requests in the previous completed tick / tick length, keyed by the tick they serve."""
    g = (watermarked(decisions, "decision_ts", delay)
         .groupBy(F.window("decision_ts", f"{tick_seconds} seconds")).agg(F.count(F.lit(1)).alias("n")))
    return g.select((tick_of(F.col("window.start"), tick_seconds) + 1).alias("tick"),
                    (F.col("n") / F.lit(float(tick_seconds))).alias("system_tps"))


METER_SECONDS = 60
METER_OUT = T.StructType([T.StructField("txn_id", T.LongType()), T.StructField("system_tps", T.DoubleType())])
METER_STATE = "second long, n long"
#: Seconds of one window of the meter; each also holds the METER_SECONDS before it.
METER_BLOCK = 600


def meter_batch(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST10, one micro-batch: (requests per second over the 60 completed seconds before each request, cells after it).

    Requests are counted per second first; the sums are windows over blocks of ``METER_BLOCK`` seconds, to which
    the last 60 seconds of the block before are copied, so no window runs over the whole clock.
    """
    asked = batch.where(F.col("txn_id").isNotNull()).select("txn_id", F.unix_seconds("decision_ts").alias("second"))
    cells = (asked.groupBy("second").agg(F.count(F.lit(1)).alias("n")).unionByName(before)
             .groupBy("second").agg(F.sum("n").alias("n")))
    second = F.col("second")
    own, near = F.floor(second / METER_BLOCK), F.floor((second + METER_SECONDS) / METER_BLOCK)
    blocks = cells.select("second", "n", F.explode(F.array_distinct(F.array(own, near))).alias("block"))
    prior = Window.partitionBy("block").orderBy("second").rangeBetween(-METER_SECONDS, -1)
    sums = blocks.withColumn("n", F.sum("n").over(prior)).where(F.col("block") == own).select("second", "n")
    rows = asked.join(sums, "second", "left").select(
        "txn_id", (F.coalesce("n", F.lit(0)) / F.lit(float(METER_SECONDS))).alias("system_tps"))
    last = cells.agg(F.max("second")).scalar()
    return rows, cells.where(F.col("second") >= last - METER_SECONDS)   # a later request may fall into the last second


def run_ingress_meter(spark: SparkSession, decisions: DataFrame, path: str | None = None) -> DataFrame:
    """ST10: the ingress rate as of each request, read before the request is counted; redelivered requests count once.

    Between micro-batches the counts of the last 61 seconds are kept, one row per second.
    """
    root = path or shared_path(spark, "st10")

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        before = spark.read.schema(METER_STATE).parquet(f"{root}/state/{batch_id - 1}") if batch_id else spark.createDataFrame([], METER_STATE)
        rows, after = meter_batch(batch, before)
        after.write.mode("overwrite").parquet(f"{root}/state/{batch_id}")
        return rows

    return drain(spark, dedup_decisions(decisions), "st10", METER_OUT, per_batch=per_batch, path=root)[0].drop("batch_id")


def dedup_decisions(decisions: DataFrame, delay: int = CALLBACK_TTL) -> DataFrame:
    """Requests without those delivered again within the watermark, in the same micro-batch or a later one."""
    return watermarked(decisions, "decision_ts", delay).dropDuplicatesWithinWatermark(["txn_id"])


# ------------------------------------------------------------- running amounts
BANK_OUT = T.StructType([T.StructField("txn_id", T.LongType()), T.StructField("bank", T.StringType()),
                         T.StructField("amount_to_bank_avg_ratio", T.DoubleType())])


def bank_amount_batch(batch: DataFrame, before: DataFrame | None, block_size: int) -> tuple[DataFrame, DataFrame]:
    """ST9, one micro-batch: (ratio per transaction, totals per bank after it).

    ``before`` holds each bank's sum and count over all earlier micro-batches.  Inside the batch, sums per
    (bank, block of transactions) and running sums inside a block replace a running sum over a whole bank,
    so a bank with most of the traffic is spread over its blocks.
    """
    a = (batch.where(F.col("txn_id").isNotNull()).select("txn_id", "bank", "amount")
         .withColumn("block", block_of("txn_id", block_size)))
    blocks = a.groupBy("bank", "block").agg(F.sum("amount").alias("amount_sum"), F.count(F.lit(1)).alias("amount_count"))
    prefix = block_prefix(blocks, ["bank"], sums=["amount_sum", "amount_count"])
    totals = blocks.groupBy("bank").agg(F.sum("amount_sum").alias("amount_sum"), F.sum("amount_count").alias("amount_count"))
    w = in_block_window(["bank"])
    x = a.select("*", F.sum("amount").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n")).join(prefix, ["bank", "block"])
    s = F.coalesce("s", F.lit(0.0)) + F.col("prev_amount_sum")
    n = F.col("n") + F.col("prev_amount_count")
    if before is not None:
        old = before.select("bank", F.col("amount_sum").alias("s0"), F.col("amount_count").alias("n0"))
        x = x.join(old, "bank", "left")
        s, n = s + F.coalesce("s0", F.lit(0.0)), n + F.coalesce("n0", F.lit(0))
        totals = (totals.unionByName(before.select("bank", "amount_sum", "amount_count"))
                  .groupBy("bank").agg(F.sum("amount_sum").alias("amount_sum"), F.sum("amount_count").alias("amount_count")))
    ratio = F.when(n > 0, F.col("amount") / (s / n))
    return x.select("txn_id", "bank", ratio.alias("amount_to_bank_avg_ratio")), totals


def run_bank_amount(spark: SparkSession, decisions: DataFrame, block_size: int, path: str | None = None) -> DataFrame:
    """ST9: per bank, the ratio of each amount to the mean of all earlier ones, read before it is added.

    Transactions count in the order of micro-batches, and by id inside one (the reference contract: the
    accumulator is updated after the prediction).  A decision delivered again counts once.  Each micro-batch writes the totals after it beside its
    result, in a folder named by its id, and starts from those of the micro-batch before.
    """
    root = path or shared_path(spark, "st9")

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        before = None
        if batch_id:
            before = spark.read.schema("bank string, amount_sum double, amount_count long").parquet(
                f"{root}/totals/{batch_id - 1}")
        rows, totals = bank_amount_batch(batch, before, block_size)
        totals.write.mode("overwrite").parquet(f"{root}/totals/{batch_id}")
        return rows

    return drain(spark, dedup_decisions(decisions), "st9", BANK_OUT, per_batch=per_batch, path=root)[0].drop("batch_id")


# ------------------------------------------------------------- incident state
INCIDENT_OUT = T.StructType([T.StructField("route_id", T.StringType()), T.StructField("tick", T.LongType()),
                             T.StructField("route_success_rate_5m", T.DoubleType()),
                             T.StructField("route_flagged_down", T.DoubleType()),
                             T.StructField("time_since_last_failure", T.DoubleType())])


def closed_cells(outcomes: DataFrame, tick_seconds: int, delay: int = CALLBACK_TTL) -> DataFrame:
    """Counts per (route, tick), each once, when the watermark has passed the tick (append mode)."""
    g = (dedup_outcomes(outcomes, delay, "attempt_ts")
         .groupBy("route_id", F.window("attempt_ts", f"{tick_seconds} seconds"))
         .agg(F.count(F.lit(1)).alias("n"), F.sum("success").cast("long").alias("k")))
    return g.select("route_id", tick_of(F.col("window.start"), tick_seconds).alias("tick"), "n", "k")


def incident_batch(cells: DataFrame, before: DataFrame | None, w: int = C.WINDOW_5) -> tuple[DataFrame, DataFrame]:
    """ST4, one micro-batch of closed cells: (one row per route and tick, state after it).

    The state has per route its next tick, its last flagged tick and the counts of its last ``w`` ticks.
    The flag raised at m affects m+1 onward.
    """
    new = cells.groupBy("route_id").agg(F.min("tick").alias("lo"), F.max("tick").alias("hi"))
    if before is None:
        routes = new.withColumn("last_flagged", F.lit(None).cast("long"))
    else:
        old = before.select("route_id", F.col("next_tick").alias("o_next"), "last_flagged")
        routes = new.join(old, "route_id", "full").select(
            "route_id", F.coalesce("o_next", "lo").alias("lo"), F.coalesce(F.col("hi"), F.col("o_next") - 1).alias("hi"), "last_flagged")
        cells = cells.select("route_id", "tick", "n", "k").unionByName(
            before.select("route_id", F.explode("cells").alias("c")).select("route_id", "c.tick", "c.n", "c.k"))
    # one row per route and tick: the ticks to evaluate, and the w before them
    spine = routes.select("route_id", "lo", "last_flagged", F.explode(
        F.sequence(F.col("lo") - w, F.greatest("hi", F.col("lo") - 1))).alias("tick"))
    spine = spine.join(cells.select("route_id", "tick", "n", "k"), ["route_id", "tick"], "left")
    spine = spine.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "k")})
    prior = Window.partitionBy("route_id").orderBy("tick").rowsBetween(-w, -1)
    earlier = Window.partitionBy("route_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("n").over(prior)
    x = spine.withColumn("rate", F.when(F.col("tick") >= F.col("lo"), F.when(n > 0, F.sum("k").over(prior) / n)))
    x = x.withColumn("flagged", F.coalesce(F.col("rate") < C.FLAG_DOWN_THRESHOLD, F.lit(False)))
    x = x.withColumn("since", F.coalesce(F.max(F.when(F.col("flagged"), F.col("tick"))).over(earlier), F.col("last_flagged")))
    rows = x.where(F.col("tick") >= F.col("lo")).select(
        "route_id", "tick", F.col("rate").alias("route_success_rate_5m"), F.col("flagged").cast("double").alias("route_flagged_down"),
        F.coalesce((F.col("tick") - F.col("since")).cast("double"), F.lit(C.NO_EVENT_SENTINEL)).alias("time_since_last_failure"))
    last = F.max("tick").over(Window.partitionBy("route_id"))
    state = (x.withColumn("end", last).groupBy("route_id").agg(
        (F.max("tick") + 1).alias("next_tick"),
        F.greatest(F.max(F.when(F.col("flagged"), F.col("tick"))), F.max("last_flagged")).alias("last_flagged"),
        F.filter(F.collect_list(F.when((F.col("tick") > F.col("end") - w) & (F.col("n") > 0), F.struct("tick", "n", "k"))),
                 lambda c: c.isNotNull()).alias("cells")))
    return rows, state


def run_incident_state(spark: SparkSession, outcomes: DataFrame, tick_seconds: int, path: str | None = None) -> DataFrame:
    """ST4: per-route incident state advanced over closed ticks, from a route's first to its last active tick.

    Rows are counted per (route, tick) over all tasks first; only these counts, one per route and tick,
    meet in a route's task.  Each micro-batch writes the state after it in a folder named by its id.
    """
    root = path or shared_path(spark, "st4")
    state = "route_id string, next_tick long, last_flagged long, cells array<struct<tick:long,n:long,k:long>>"

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        before = spark.read.schema(state).parquet(f"{root}/state/{batch_id - 1}") if batch_id else None
        rows, after = incident_batch(batch, before)
        after.write.mode("overwrite").parquet(f"{root}/state/{batch_id}")
        return rows

    return drain(spark, closed_cells(outcomes, tick_seconds), "st4", INCIDENT_OUT, per_batch=per_batch,
                 path=root)[0].drop("batch_id")
