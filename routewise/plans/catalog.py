"""Registered queries: one per operator of the inventory.

Each entry is ``key -> fn(spark, sf_dir) -> DataFrame`` plus, where the
operator is SQL-expressible, an oracle SQL string (see :mod:`oracle`).
Every query reads the driver tables (through the attempts binding) and
runs over whole tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.functions.exprs import amount_band, day_in_week, hour_of_day
from routewise.operators import features as FT
from routewise.operators.timeline import minute_table, semi_dense_cells
from routewise.plans.context import Ctx, rounded
from routewise.plans.oracle import with_base

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TABLES_FOR_ORACLE = ("region nation customer supplier part orders lineitem events documents embeddings "
                     "pages benchmark labels conversations").split()


def oracle_sql_rounded() -> dict[str, str]:
    """Oracle SQL with every DOUBLE output rounded to 6 dp (as the Spark side)."""
    try:
        from routewise.plans.oracle_doubles import DOUBLE_COLUMNS, WIDE_COLUMNS
    except ImportError:  # pragma: no cover
        DOUBLE_COLUMNS, WIDE_COLUMNS = {}, {}
    out = {}
    for k, sql in ORACLE.items():
        rep = [f"round({c}, 6) AS {c}" for c in DOUBLE_COLUMNS.get(k, [])]
        rep += [f"CAST({c} AS BIGINT) AS {c}" for c in WIDE_COLUMNS.get(k, [])]
        if rep:
            out[k] = f"SELECT * REPLACE ({', '.join(rep)}) FROM (\n{sql}\n) AS oracle_result"
        else:
            out[k] = sql
    return out


def queries_rounded() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries as the correctness check compares them: doubles rounded to 6 dp, as in the oracle."""
    def of(query):
        @functools.wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(query(spark, sf_dir))
        return run
    return {k: of(q) for k, q in QUERIES.items()}


def register(key: str, sql: str | None = None):
    def deco(fn: Callable[[Ctx], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Ctx(spark, sf_dir))
        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_base(sql)
        return fn
    return deco


ATTEMPT_COLS = "txn_id, tick, amount, bank, network, payment_method, merchant, device, risk, route_id, success, latency_ms"


# ------------------------------------------------------------------ sources
@register("read_attempts", f"SELECT {ATTEMPT_COLS} FROM attempts")
def q_read_attempts(c: Ctx) -> DataFrame:
    """SRC1: the attempts fact table bound from `events`."""
    return c.attempts


@register("read_route_metrics", """
SELECT route_id, tick, n AS request_count, k AS success_count, lat AS latency_sum, system_tps, route_utilization
FROM rlive""")
def q_read_route_metrics(c: Ctx) -> DataFrame:
    """SRC2: dense route metrics, one row per (route, tick) of the timeline, no gaps."""
    total = c.state.total_ticks
    grid = c.routes.select("route_id", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("tick"))
    r = c.state.route.select("route_id", "tick", "request_count", "success_count", "latency_sum")
    glob = (c.state.cells.where(F.col("scope") == "global")
            .select((F.col("tick") + 1).alias("tick"), (F.col("request_count") / F.lit(float(c.tick_seconds))).alias("system_tps")))
    out = (grid.join(r, ["route_id", "tick"], "left").join(glob, "tick", "left")
           .select("route_id", "tick",
                   F.coalesce("request_count", F.lit(0)).cast("long").alias("request_count"),
                   F.coalesce("success_count", F.lit(0)).cast("long").alias("success_count"),
                   F.coalesce("latency_sum", F.lit(0.0)).alias("latency_sum"),
                   F.coalesce("system_tps", F.lit(0.0)).alias("system_tps")))
    return out.withColumn("route_utilization", F.col("system_tps") * FT.route_share(F.col("route_id"))
                          / FT.route_capacity(F.col("route_id")))


# ------------------------------------------------------------ aggregations
@register("minute_table", "SELECT route_id, tick, request_count, success_count, latency_sum FROM rcell")
def q_minute_table(c: Ctx) -> DataFrame:
    """G1: per (route, tick) count, successes, latency sum."""
    return minute_table(c.attempts, ["route_id"]).drop("failure_count")


@register("bank_minute", "SELECT bank, tick, f AS failure_count, n AS request_count FROM bcell")
def q_bank_minute(c: Ctx) -> DataFrame:
    """Per (bank, tick) failures and attempts."""
    return minute_table(c.attempts, ["bank"]).select("bank", "tick", "failure_count", "request_count")


@register("network_minute", "SELECT network, tick, f AS failure_count, n AS request_count FROM ncell")
def q_network_minute(c: Ctx) -> DataFrame:
    """Per (network, tick) failures and attempts."""
    return minute_table(c.attempts, ["network"]).select("network", "tick", "failure_count", "request_count")


@register("route_minute", "SELECT route_id, tick, failure_count, request_count FROM rcell")
def q_route_minute(c: Ctx) -> DataFrame:
    """Per (route, tick) failures and attempts."""
    return minute_table(c.attempts, ["route_id"]).select("route_id", "tick", "failure_count", "request_count")


@register("training_baselines", "SELECT route_id, route_base_success_rate, route_base_latency_ms FROM base")
def q_training_baselines(c: Ctx) -> DataFrame:
    """Route means over training ticks only."""
    return FT.training_baselines(c.attempts, FT.bounds(c.attempts)[1], c.routes)


@register("overall_baseline", "SELECT prior AS overall_baseline FROM overall")
def q_overall_baseline(c: Ctx) -> DataFrame:
    """Unweighted mean of route baselines."""
    b = FT.training_baselines(c.attempts, FT.bounds(c.attempts)[1], c.routes)
    return b.agg(F.avg("route_base_success_rate").alias("overall_baseline"))


@register("route_metrics_rollup", """
SELECT route_id, tick, n AS request_count, k AS success_count, lat AS latency_sum, system_tps, route_utilization
FROM rlive WHERE active""")
def q_route_metrics_rollup(c: Ctx) -> DataFrame:
    """Per active (route, tick): requests, successes, latency, system tps, utilization."""
    return c.state.route.where("is_active").select(
        "route_id", "tick", "request_count", "success_count", "latency_sum", "system_tps", "route_utilization")


@register("effective_capacity", """
SELECT route_id, tick, health_label, route_effective_capacity_tps FROM rlive WHERE active""")
def q_effective_capacity(c: Ctx) -> DataFrame:
    """Observed health label and capacity x health multiplier."""
    return c.state.route.where("is_active").select("route_id", "tick", "health_label", "route_effective_capacity_tps")


# ------------------------------------------------------------------ windows
@register("prior_rolling_sum", """
SELECT route_id, tick, coalesce(n5, 0) AS requests_5m, coalesce(k5, 0) AS successes_5m, coalesce(l5, 0.0) AS latency_5m,
  coalesce(n15, 0) AS requests_15m, coalesce(k15, 0) AS successes_15m FROM rwin WHERE active""")
def q_prior_rolling_sum(c: Ctx) -> DataFrame:
    """Clock-window sums over [m-w, m) at every active route tick."""
    from routewise.operators.timeline import prior_rolling_sum as prs
    k = ["route_id"]
    cells = minute_table(c.attempts, k)
    spine = semi_dense_cells(cells, k, C.WINDOW_5)
    return spine.select(
        "route_id", "tick", "is_active",
        prs("request_count", k, 5).alias("requests_5m"), prs("success_count", k, 5).alias("successes_5m"),
        prs("latency_sum", k, 5).alias("latency_5m"), prs("request_count", k, 15).alias("requests_15m"),
        prs("success_count", k, 15).alias("successes_15m"),
    ).where("is_active").drop("is_active")


def _route_cols(c: Ctx, *cols: str) -> DataFrame:
    return c.state.route.where("is_active").select("route_id", "tick", *cols)


@register("route_success_rate_5m",
          "SELECT route_id, tick, route_success_rate_5m, route_success_rate_15m FROM rlive WHERE active")
def q_route_success_rate(c: Ctx) -> DataFrame:
    """Windowed success rates, NULL without traffic."""
    return _route_cols(c, "route_success_rate_5m", "route_success_rate_15m")


@register("route_avg_latency_5m", "SELECT route_id, tick, route_avg_latency_5m FROM rlive WHERE active")
def q_route_avg_latency(c: Ctx) -> DataFrame:
    """Windowed latency sum / requests."""
    return _route_cols(c, "route_avg_latency_5m")


@register("route_current_load",
          "SELECT route_id, tick, route_current_load, route_requests_1m FROM rlive WHERE active")
def q_route_current_load(c: Ctx) -> DataFrame:
    """Prior request counts over 2 and 1 ticks (0 when empty)."""
    return _route_cols(c, "route_current_load", "route_requests_1m")


@register("route_flagged_down", "SELECT route_id, tick, route_flagged_down FROM rlive WHERE active")
def q_route_flagged_down(c: Ctx) -> DataFrame:
    """1.0 when the 5-tick rate is known and < 0.70."""
    return _route_cols(c, "route_flagged_down")


@register("time_since_last_failure", "SELECT route_id, tick, time_since_last_failure FROM rlive WHERE active")
def q_time_since_last_failure(c: Ctx) -> DataFrame:
    """Ticks since the last flagged tick strictly before (semi-dense spine vs dense oracle)."""
    return _route_cols(c, "time_since_last_failure")


@register("time_since_any_failure", """
SELECT route_id, tick, coalesce(CAST(tick - max(CASE WHEN failure_count > 0 THEN tick END) OVER
  (PARTITION BY route_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 9999.0)
  AS time_since_any_failure FROM rcell""")
def q_time_since_any_failure(c: Ctx) -> DataFrame:
    """W7 (v1 definition): ticks since any failed attempt of the route, strictly before."""
    from routewise.operators.timeline import last_before
    cells = minute_table(c.attempts, ["route_id"])
    last = last_before(F.when(F.col("failure_count") > 0, F.col("tick")), ["route_id"])
    return cells.select("route_id", "tick",
                        F.coalesce((F.col("tick") - last).cast("double"), F.lit(C.NO_EVENT_SENTINEL))
                        .alias("time_since_any_failure"))


@register("bank_route_success_rate_15m", "SELECT bank, route_id, tick, bank_route_success_rate_15m FROM brfeat")
def q_bank_route_rate(c: Ctx) -> DataFrame:
    """Shrunk 15-tick bank x route success rate."""
    return c.state.bank_route.select("bank", "route_id", "tick", "bank_route_success_rate_15m")


@register("bank_failure_rate_5m", "SELECT bank, tick, bank_failure_rate_5m FROM bfeat")
def q_bank_failure_rate(c: Ctx) -> DataFrame:
    """Failures / attempts over the previous 5 active bank ticks."""
    return c.state.bank_rate


@register("network_failure_rate_5m", "SELECT network, tick, network_failure_rate_5m FROM nfeat")
def q_network_failure_rate(c: Ctx) -> DataFrame:
    """Same rule by network."""
    return c.state.network_rate


@register("route_failure_rate_1m", "SELECT route_id, tick, route_failure_rate_1m FROM r1m")
def q_route_failure_rate_1m(c: Ctx) -> DataFrame:
    """Failure rate of the previous active route tick."""
    return _route_cols(c, "route_failure_rate_1m")


@register("time_since_last_bank_route_success", "SELECT txn_id, time_since_last_bank_route_success FROM txnf")
def q_tslbrs(c: Ctx) -> DataFrame:
    """Ticks since the last prior success of (bank, route) in txn order."""
    return FT.txn_order_features(c.attempts, c.state.cells, c.state.block_size, c.state.prefix).select(
        "txn_id", "time_since_last_bank_route_success")


@register("amount_to_bank_avg_ratio", "SELECT txn_id, amount_to_bank_avg_ratio FROM txnf")
def q_amount_ratio(c: Ctx) -> DataFrame:
    """Amount / mean of all prior amounts of the bank in txn order."""
    return FT.txn_order_features(c.attempts, c.state.cells, c.state.block_size, c.state.prefix).select(
        "txn_id", "amount_to_bank_avg_ratio")


# -------------------------------------------------------------------- joins
@register("spine_fill", """
SELECT route_id, tick, n AS request_count, k AS success_count FROM rdense d
WHERE EXISTS (SELECT 1 FROM rcell c WHERE c.route_id = d.route_id AND c.tick BETWEEN d.tick - 5 AND d.tick)""")
def q_spine_fill(c: Ctx) -> DataFrame:
    """Semi-dense timeline with zero-filled cells (== dense where a window can see data)."""
    cells = minute_table(c.attempts, ["route_id"])
    total = FT.bounds(c.attempts)[0]
    return semi_dense_cells(cells, ["route_id"], C.WINDOW_5, total).select(
        "route_id", "tick", "request_count", "success_count")


@register("attach_route_features", """
SELECT txn_id, route_success_rate_5m, route_success_rate_15m, route_avg_latency_5m, route_current_load,
  route_requests_1m, time_since_last_failure, route_flagged_down, route_utilization,
  route_effective_capacity_tps, system_tps FROM ft""")
def q_attach_route_features(c: Ctx) -> DataFrame:
    """Left equi-join of route features on (route_id, tick)."""
    return c.features(False).select("txn_id", *FT.ROUTE_LIVE)


@register("attach_bank_route", "SELECT txn_id, bank_route_success_rate_15m FROM ft")
def q_attach_bank_route(c: Ctx) -> DataFrame:
    """Left equi-join on (bank, route_id, tick)."""
    return c.features(False).select("txn_id", "bank_route_success_rate_15m")


@register("attach_baselines", "SELECT txn_id, route_base_success_rate, route_base_latency_ms FROM ft")
def q_attach_baselines(c: Ctx) -> DataFrame:
    """Left join of training baselines on route_id."""
    return c.features(False).select("txn_id", "route_base_success_rate", "route_base_latency_ms")


@register("attach_sparse_rates",
          "SELECT txn_id, bank_failure_rate_5m, network_failure_rate_5m, route_failure_rate_1m FROM fe")
def q_attach_sparse_rates(c: Ctx) -> DataFrame:
    """Active-row rates attached back to rows."""
    return c.features(True).select("txn_id", "bank_failure_rate_5m", "network_failure_rate_5m",
                                   "route_failure_rate_1m")


# ------------------------------------------------------ scalar projections
@register("time_features", "SELECT txn_id, tick, (tick*60 // 1440) % 7 AS day_in_week, (tick*60 % 1440) // 60 AS hour_of_day FROM attempts")
def q_time_features(c: Ctx) -> DataFrame:
    """day_in_week and hour_of_day on the integer timeline."""
    a = c.attempts
    return a.select("txn_id", "tick", day_in_week(F.col("tick"), c.tick_seconds).alias("day_in_week"),
                    hour_of_day(F.col("tick"), c.tick_seconds).alias("hour_of_day"))


@register("route_failure_rate_5m", "SELECT txn_id, route_failure_rate_5m, route_failure_rate_15m FROM fe")
def q_route_failure_rates(c: Ctx) -> DataFrame:
    """1 - success rate (5 and 15 ticks)."""
    return c.features(True).select("txn_id", "route_failure_rate_5m", "route_failure_rate_15m")


@register("route_success_drop_5m", "SELECT txn_id, route_success_drop_5m, route_success_drop_15m FROM fe")
def q_route_success_drop(c: Ctx) -> DataFrame:
    """Base rate - windowed rate."""
    return c.features(True).select("txn_id", "route_success_drop_5m", "route_success_drop_15m")


@register("route_latency_ratio", "SELECT txn_id, route_latency_ratio FROM fe")
def q_route_latency_ratio(c: Ctx) -> DataFrame:
    """Avg latency 5 / (base latency + 1e-6)."""
    return c.features(True).select("txn_id", "route_latency_ratio")


@register("bank_route_gap", "SELECT txn_id, bank_route_gap FROM fe")
def q_bank_route_gap(c: Ctx) -> DataFrame:
    """P5: bank x route rate - route rate (15 ticks)."""
    return c.features(True).select("txn_id", "bank_route_gap")


@register("route_stress", "SELECT txn_id, route_stress FROM fe")
def q_route_stress(c: Ctx) -> DataFrame:
    """Utilization x failure rate 15."""
    return c.features(True).select("txn_id", "route_stress")


@register("inf_to_null", """
SELECT txn_id, CASE WHEN latency_ms - 1.0 <> 0 THEN amount / (latency_ms - 1.0) END AS amount_per_latency FROM attempts""")
def q_inf_to_null(c: Ctx) -> DataFrame:
    """A ratio whose zero denominators become NULL instead of +-inf."""
    from routewise.functions.exprs import ratio
    return c.attempts.select("txn_id", ratio(F.col("amount"), F.col("latency_ms") - 1.0).alias("amount_per_latency"))


@register("route_cost", "SELECT txn_id, route_id, route_cost_percent FROM ft")
def q_route_cost(c: Ctx) -> DataFrame:
    """Static per-route fee."""
    return c.attempts.select("txn_id", "route_id", FT.route_fee(F.col("route_id")).alias("route_cost_percent"))


@register("timeline_bounds", "SELECT total_ticks, train_ticks FROM bounds")
def q_timeline_bounds(c: Ctx) -> DataFrame:
    """total = max(tick) + 1, train = int(total * 0.75)."""
    from routewise.operators.timeline import timeline_bounds
    return timeline_bounds(c.attempts, C.TRAIN_FRACTION)


@register("label_split", "SELECT txn_id, dataset_split FROM ft")
def q_label_split(c: Ctx) -> DataFrame:
    """P10: train if tick < train_ticks else test."""
    train = FT.bounds(c.attempts)[1]
    return c.attempts.select("txn_id", F.when(F.col("tick") < train, "train").otherwise("test").alias("dataset_split"))


@register("feature_projection", "SELECT " + ", ".join(C.FEATURE_TABLE_COLUMNS) + " FROM ft")
def q_feature_projection(c: Ctx) -> DataFrame:
    """The 28-column leak-safe feature table."""
    return c.features(False)


@register("model_inputs", "SELECT " + ", ".join(C.NUMERIC_FEATURES + C.CATEGORICAL_FEATURES) + ", txn_id FROM fe")
def q_model_inputs(c: Ctx) -> DataFrame:
    """26 numeric + 7 categorical model inputs (txn_id kept as key)."""
    return c.features(True).select(*C.NUMERIC_FEATURES, *C.CATEGORICAL_FEATURES, "txn_id")


@register("feature_table", "SELECT * FROM fe")
def q_feature_table(c: Ctx) -> DataFrame:
    """L1: 28 columns + 12 engineered features for every attempt."""
    return c.features(True)


@register("feature_table_minute", "SELECT txn_id, tick, route_success_rate_5m, route_success_rate_15m, "
          "bank_route_success_rate_15m, bank_failure_rate_5m, network_failure_rate_5m, route_failure_rate_1m, "
          "time_since_last_bank_route_success, amount_to_bank_avg_ratio FROM fe")
def q_feature_table_minute(c: Ctx) -> DataFrame:
    """L1 at the minute grain of the reference: the same plan over 60 times as many ticks."""
    m = Ctx(c.spark, c.sf_dir, tick_seconds=60)
    return m.features(True).select("txn_id", "tick", "route_success_rate_5m", "route_success_rate_15m",
                                   "bank_route_success_rate_15m", "bank_failure_rate_5m", "network_failure_rate_5m",
                                   "route_failure_rate_1m", "time_since_last_bank_route_success",
                                   "amount_to_bank_avg_ratio")


ORACLE["feature_table_minute"] = ORACLE["feature_table_minute"].replace("/3600)", "/60)")


@register("amount_bands", """
SELECT payment_method, CAST(amount >= 100 AS INT) + CAST(amount >= 1000 AS INT) + CAST(amount >= 10000 AS INT) AS amount_band,
  count(*) AS attempts, CAST(sum(success) AS BIGINT) AS successes, avg(amount) AS mean_amount
FROM attempts GROUP BY ALL""")
def q_amount_bands(c: Ctx) -> DataFrame:
    """P13 (re-aimed from a simulator part): attempts and successes by payment method and size of amount."""
    return c.attempts.groupBy("payment_method", amount_band(F.col("amount")).alias("amount_band")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("success").cast("long").alias("successes"),
        F.avg("amount").alias("mean_amount"))


@register("load_response", """
SELECT route_id, route_current_load, count(*) AS ticks, CAST(sum(n) AS BIGINT) AS attempts, sum(k) / sum(n) AS success_rate,
  sum(lat) / sum(n) AS mean_latency FROM rlive WHERE active GROUP BY route_id, route_current_load""")
def q_load_response(c: Ctx) -> DataFrame:
    """P14 (re-aimed from a simulator part): observed success and latency of a route by its recent load."""
    n = F.sum("request_count")
    return (c.state.route.where("is_active").groupBy("route_id", "route_current_load")
            .agg(F.count(F.lit(1)).alias("ticks"), n.alias("attempts"), (F.sum("success_count") / n).alias("success_rate"),
                 (F.sum("latency_sum") / n).alias("mean_latency")))


# --------------------------------------------------- candidates and policies
from routewise.operators import candidates as CD  # noqa: E402
from routewise.operators import policy as PL  # noqa: E402
from routewise.plans.context import candidates  # noqa: E402
from routewise.plans.oracle import with_cands  # noqa: E402


def register_c(key: str, sql: str | None = None):
    """Register a query whose oracle needs the candidate CTEs."""
    def deco(fn):
        register(key)(fn)
        if sql is not None:
            ORACLE[key] = with_cands(sql)
        return fn
    return deco


@register_c("expand_candidates", """
SELECT t.txn_id, r.route_id, t.actual_route_id, t.actual_success
FROM (SELECT DISTINCT txn_id, actual_route_id, actual_success FROM cand) t CROSS JOIN routes r""")
def q_expand_candidates(c: Ctx) -> DataFrame:
    """Every test transaction x all routes, actual route/outcome kept."""
    txns = CD.test_attempts(c.attempts, FT.bounds(c.attempts)[1])
    return CD.expand_candidates(txns).select("txn_id", "route_id", "actual_route_id", "actual_success")


@register_c("eligible_routes", "SELECT txn_id, route_id, network FROM cand")
def q_eligible_routes(c: Ctx) -> DataFrame:
    """Candidate routes supporting both payment method and network."""
    txns = CD.test_attempts(c.attempts, FT.bounds(c.attempts)[1])
    return CD.eligible_routes(txns, c.eligibility).select("txn_id", "route_id", "network")


@register("no_eligible_route", """
SELECT txn_id, payment_method, network FROM attempts a
WHERE NOT EXISTS (SELECT 1 FROM elig e WHERE e.payment_method = a.payment_method AND e.network = a.network)""")
def q_no_eligible_route(c: Ctx) -> DataFrame:
    """Transactions with zero eligible routes (422 online, skipped offline)."""
    return CD.no_eligible_route(c.attempts, c.eligibility).select("txn_id", "payment_method", "network")


@register("no_eligible_route_outage", """
SELECT txn_id, payment_method, network FROM attempts a WHERE NOT EXISTS (
  SELECT 1 FROM elig e WHERE e.payment_method = a.payment_method AND e.network = a.network AND e.route_id = 'R1')""")
def q_no_eligible_route_outage(c: Ctx) -> DataFrame:
    """J8 with one route in service: some networks' transactions have no route, the others do."""
    return CD.no_eligible_route(c.attempts, c.eligibility.where(F.col("route_id") == "R1")).select("txn_id", "payment_method", "network")


CAND_FEATURE_COLS = ("txn_id", "route_id", *C.NUMERIC_FEATURES)


@register_c("candidate_feature_lookup", "SELECT " + ", ".join(CAND_FEATURE_COLS) + " FROM cands")
def q_candidate_feature_lookup(c: Ctx) -> DataFrame:
    """Per-route features looked up for every candidate, engineered columns recomputed."""
    return candidates(c).select(*CAND_FEATURE_COLS)


@register("lookup_first_in_tick", """
SELECT bank, route_id, tick, arg_min(t.time_since_last_bank_route_success, a.txn_id) AS time_since_last_bank_route_success
FROM attempts a JOIN txnf t USING (txn_id) GROUP BY bank, route_id, tick""")
def q_lookup_first_in_tick(c: Ctx) -> DataFrame:
    """First row per (bank, route, tick) in txn order (order-aware dedup)."""
    f = FT.txn_order_features(c.attempts, c.state.cells, c.state.block_size, c.state.prefix)
    return CD.lookup_first_in_tick(f, ["bank", "route_id"], "time_since_last_bank_route_success")


@register_c("asof_group_state",
            "SELECT txn_id, route_id, route_failure_rate_1m, time_since_last_bank_route_success FROM cands")
def q_asof_group_state(c: Ctx) -> DataFrame:
    """Latest group state strictly before the tick, for candidate keys with or without a row there."""
    return candidates(c).select("txn_id", "route_id", "route_failure_rate_1m", "time_since_last_bank_route_success")


@register_c("policy_rows", "SELECT c.txn_id, c.route_id, c.p, c.outcome_proxy FROM argmax JOIN cands c USING (txn_id, route_id)")
def q_policy_rows(c: Ctx) -> DataFrame:
    """Candidate rows where route = the policy's choice (argmax policy)."""
    return PL.policy_choices(candidates(c), c.eligibility).select("txn_id", "best.*")


@register_c("policy_argmax", "SELECT txn_id, route_id, p FROM argmax")
def q_policy_argmax(c: Ctx) -> DataFrame:
    """Best-score route per transaction (p desc, then route order)."""
    return PL.policy_argmax(candidates(c))


@register_c("policy_round_robin", "SELECT txn_id, route_id FROM rr")
def q_policy_round_robin(c: Ctx) -> DataFrame:
    """R1..R4 rotation carried across transactions, skipping ineligible routes."""
    return PL.policy_round_robin(candidates(c))


@register_c("weighted_split", "SELECT txn_id, route_id FROM wsplit")
def q_weighted_split(c: Ctx) -> DataFrame:
    """Deterministic weighted assignment among eligible routes."""
    txns = CD.test_attempts(c.attempts, FT.bounds(c.attempts)[1])
    return PL.policy_weighted_split(txns, c.eligibility)


@register_c("outcome_proxy", "SELECT txn_id, route_id, outcome_proxy FROM cands")
def q_outcome_proxy(c: Ctx) -> DataFrame:
    """Candidate outcome := route_success_rate_5m."""
    return candidates(c).select("txn_id", "route_id", "outcome_proxy")


@register_c("eligible_by_network", "SELECT network, route_id, count(*) AS n FROM cand GROUP BY network, route_id")
def q_eligible_by_network(c: Ctx) -> DataFrame:
    """Candidate rows per (network, route)."""
    txns = CD.test_attempts(c.attempts, FT.bounds(c.attempts)[1])
    return CD.eligible_routes(txns, c.eligibility).groupBy("network", "route_id").agg(F.count(F.lit(1)).alias("n"))


@register_c("eligible_set", """
SELECT txn_id, string_agg(route_id, ',' ORDER BY route_id) AS eligible_routes, count(*) AS n_eligible,
  count(*) OVER () AS n_txn FROM cand GROUP BY txn_id""")
def q_eligible_set(c: Ctx) -> DataFrame:
    """Eligible route list per transaction and the distinct transaction count."""
    txns = CD.test_attempts(c.attempts, FT.bounds(c.attempts)[1])
    e = CD.eligible_routes(txns, c.eligibility)
    g = e.groupBy("txn_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("route_id"))).alias("eligible_routes"),
                                F.count(F.lit(1)).alias("n_eligible"))
    # distinct txn count as a scalar sub-query (no single-partition window)
    n = g.agg(F.count(F.lit(1))).scalar()
    return g.withColumn("n_txn", n)


@register_c("policy_success_rate", "SELECT policy, success_rate, n_txn FROM pol")
def q_policy_success_rate(c: Ctx) -> DataFrame:
    """Actual mean success; policy mean outcome proxy (nulls skipped)."""
    return PL.policy_summary(candidates(c), c.eligibility).drop("candidate_rows")


@register_c("policy_report", """
SELECT policy, success_rate, n_txn, success_rate - (SELECT success_rate FROM pol WHERE policy = 'round_robin')
  AS delta_vs_round_robin, (SELECT count(*) FROM cands) AS candidate_rows FROM pol""")
def q_policy_report(c: Ctx) -> DataFrame:
    """Actual / round-robin / argmax / weighted split with delta vs round robin."""
    pol = PL.policy_summary(candidates(c), c.eligibility)
    # four rows
    rr = F.max(F.when(F.col("policy") == "round_robin", F.col("success_rate"))).over(Window.partitionBy())
    return pol.select("policy", "success_rate", "n_txn", (F.col("success_rate") - rr).alias("delta_vs_round_robin"),
                      "candidate_rows")


# ---------------------------------------------------------------- evaluation
from routewise.operators import evaluate as EV  # noqa: E402
from routewise.plans.oracle import with_eval  # noqa: E402

EVAL_THRESHOLD = 0.16   # documented decision threshold


def register_e(key: str, sql: str | None = None):
    def deco(fn):
        register(key)(fn)
        if sql is not None:
            ORACLE[key] = with_eval(sql)
        return fn
    return deco


def scored(c: Ctx, engineered: bool = False) -> DataFrame:
    """Feature rows with the 3-way split and the SQL-expressible score p.

    Score-only consumers use the 28-column table (no transaction-order
    windows, so no shuffle of the fact table); the model uses all inputs.
    """
    f = EV.split_three(c.features(engineered), c.block_size, c.attempts, c.state.train_ticks)
    return f.withColumn("p", F.col("bank_route_success_rate_15m"))


EVAL_COLS = ("txn_id", "tick", "split3", "p", "success", "amount", "route_cost_percent")


def _part(c: Ctx, name: str) -> DataFrame:
    """One materialised, narrow scored frame per query; every metric reads it."""
    from routewise.plans.materialize import checkpointed
    if not hasattr(c, "_scored_narrow"):
        c._scored_narrow = checkpointed(scored(c).select(*EVAL_COLS))
    return c._scored_narrow.where(F.col("split3") == name)


@register_e("train_validation_cut", "SELECT txn_id, split3 FROM split")
def q_train_validation_cut(c: Ctx) -> DataFrame:
    """Last 20 % of training rows by (tick, txn_id) become validation."""
    return scored(c).select("txn_id", "split3")


@register_e("read_features", """
SELECT split3, count(*) AS n, min(tick) AS min_tick, max(tick) AS max_tick FROM split GROUP BY split3""")
def q_read_features(c: Ctx) -> DataFrame:
    """SRC3: the written feature table read again and split in three (train / validation / test)."""
    from routewise.sources.sinks import read_features, shared_path, write_features
    path = shared_path(c.spark, "features")
    write_features(c.features(False), path)
    f = EV.split_three(read_features(c.spark, path).select("txn_id", "tick", "dataset_split"), c.block_size)
    return f.groupBy("split3").agg(F.count(F.lit(1)).alias("n"), F.min("tick").alias("min_tick"),
                                   F.max("tick").alias("max_tick"))


@register_e("class_balance", """
SELECT count_if(success = 0) AS failures, count_if(success = 1) AS successes,
  count_if(success = 0) / count(*) AS failure_ratio, count_if(success = 1) / count_if(success = 0) AS base_weight FROM trn""")
def q_class_balance(c: Ctx) -> DataFrame:
    """Failures, successes, ratio and base weight on the training part."""
    return EV.class_balance(_part(c, "train"))


@register_e("class_weights", """
SELECT txn_id, CASE WHEN success = 0 THEN (SELECT count_if(success = 1) / count_if(success = 0) FROM trn) ELSE 1.0 END AS weight
FROM trn""")
def q_class_weights(c: Ctx) -> DataFrame:
    """M6: per-row training weight, failures weigh succ/fail."""
    return EV.class_weights(_part(c, "train")).select("txn_id", "weight")


@register_e("predict_failure", f"""
SELECT txn_id, CAST(1.0 - p >= {EVAL_THRESHOLD} AS INT) AS predicted_failure FROM tst""")
def q_predict_failure(c: Ctx) -> DataFrame:
    """1 - p >= threshold -> failure predicted."""
    from routewise.functions.exprs import predicted_failure
    return _part(c, "test").select("txn_id", predicted_failure(F.col("p"), EVAL_THRESHOLD).alias("predicted_failure"))


@register_e("calibration_bins", "SELECT bin, bin_label, n, mean_predicted_prob, actual_success_rate, gap FROM (" + """
SELECT b AS bin, '[' || printf('%.1f', b / 10.0) || '-' || printf('%.1f', (b + 1) / 10.0) || ')' AS bin_label,
  count(*) AS n, round(avg(p), 4) AS mean_predicted_prob, round(avg(success), 4) AS actual_success_rate,
  round(avg(p) - avg(success), 4) AS gap
FROM (SELECT least(""" + " + ".join(f"CAST(p >= {e!r}::DOUBLE AS INT)" for e in EV.calibration_edges()[1:]) + """, 9) AS b, p, success FROM tst)
GROUP BY b)""")
def q_calibration_bins(c: Ctx) -> DataFrame:
    """10 bins of p on the test part; empty bins omitted."""
    return EV.calibration_bins(_part(c, "test"))


@register_e("confusion_matrix", f"""
SELECT a.actual, a.predicted, count(t.txn_id) AS n FROM (VALUES (0,0),(0,1),(1,0),(1,1)) a(actual, predicted)
LEFT JOIN tst t ON t.success = a.actual AND CAST(NOT (1.0 - t.p >= {EVAL_THRESHOLD}) AS INT) = a.predicted
GROUP BY a.actual, a.predicted""")
def q_confusion_matrix(c: Ctx) -> DataFrame:
    """2x2 counts at the decision threshold."""
    return EV.confusion_matrix(_part(c, "test"), EVAL_THRESHOLD)


@register_e("classification_report", f"""
SELECT label, precision, recall, f1_score, support FROM (
 WITH cc AS (SELECT count_if(success=0 AND 1.0-p >= {EVAL_THRESHOLD}) tp, count_if(success=1 AND 1.0-p >= {EVAL_THRESHOLD}) fp,
   count_if(success=1 AND NOT 1.0-p >= {EVAL_THRESHOLD}) tn, count_if(success=0 AND NOT 1.0-p >= {EVAL_THRESHOLD}) fn FROM tst),
 m AS (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0 END p0, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0 END r0,
   CASE WHEN tn+fn>0 THEN tn/(tn+fn) ELSE 0.0 END p1, CASE WHEN tn+fp>0 THEN tn/(tn+fp) ELSE 0.0 END r1,
   tp+fn s0, tn+fp s1, tp+fp+tn+fn n FROM cc),
 f AS (SELECT *, CASE WHEN p0+r0>0 THEN 2*p0*r0/(p0+r0) ELSE 0.0 END f0, CASE WHEN p1+r1>0 THEN 2*p1*r1/(p1+r1) ELSE 0.0 END f1 FROM m)
 SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM f
 UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
 UNION ALL SELECT 'accuracy', NULL::DOUBLE, NULL::DOUBLE, (tp+tn)/n, n FROM f
 UNION ALL SELECT 'macro avg', (p0+p1)/2, (r0+r1)/2, (f0+f1)/2, n FROM f
 UNION ALL SELECT 'weighted avg', (p0*s0+p1*s1)/n, (r0*s0+r1*s1)/n, (f0*s0+f1*s1)/n, n FROM f)""")
def q_classification_report(c: Ctx) -> DataFrame:
    """precision/recall/F1/support per class, macro/weighted averages, accuracy."""
    return EV.classification_report(_part(c, "test"), EVAL_THRESHOLD)


@register_e("threshold_metrics", """
SELECT t.threshold,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS failure_precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS failure_recall,
  CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END AS failure_f1,
  (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp + fp AS predicted_failures
FROM (SELECT t.threshold, count_if(success=0 AND 1.0-p >= t.threshold) tp, count_if(success=1 AND 1.0-p >= t.threshold) fp,
  count_if(success=1 AND NOT 1.0-p >= t.threshold) tn, count_if(success=0 AND NOT 1.0-p >= t.threshold) fn
  FROM val CROSS JOIN thr13 t GROUP BY t.threshold) t""")
def q_threshold_metrics(c: Ctx) -> DataFrame:
    """Failure precision/recall/F1, accuracy, predicted failures at 13 thresholds (validation)."""
    return EV.sweep(_part(c, "validation"), C.ANALYSIS_THRESHOLDS).select(
        "threshold", "failure_precision", "failure_recall", "failure_f1", "accuracy", "predicted_failures")


@register_e("cost_at_threshold", f"""
SELECT {EVAL_THRESHOLD}::DOUBLE AS threshold, sum(cost) AS total_cost, sum(cost) / count(*) AS cost_per_txn FROM (
SELECT CASE WHEN success = 0 AND NOT (1.0 - p >= {EVAL_THRESHOLD}) THEN 50.0 + amount * 0.02
  WHEN success = 1 AND 1.0 - p >= {EVAL_THRESHOLD} THEN amount * route_cost_percent / 100.0
  WHEN success = 1 THEN -(amount * route_cost_percent / 100.0) ELSE 0.0 END AS cost FROM tst)""")
def q_cost_at_threshold(c: Ctx) -> DataFrame:
    """Business cost at the decision threshold on the test part."""
    return EV.cost_at_threshold(_part(c, "test"), EVAL_THRESHOLD)


SWEEP_COLS = ("threshold", "total_cost", "cost_per_txn", "failure_precision", "failure_recall", "failure_f1",
              "accuracy", "predicted_failures")


@register_e("cost_sweep", "SELECT " + ", ".join(SWEEP_COLS) + " FROM swf WHERE mult = 1.0")
def q_cost_sweep(c: Ctx) -> DataFrame:
    """Cost and metrics at 0.02..0.54 (27 thresholds), one scan of validation."""
    return EV.sweep(_part(c, "validation"), EV.cost_sweep_thresholds()).select(*SWEEP_COLS)


@register_e("cost_sensitivity", """
SELECT mult, arg_min(threshold, (cost_per_txn, threshold)) AS threshold, min(cost_per_txn) AS cost_per_txn,
  arg_min(failure_precision, (cost_per_txn, threshold)) AS failure_precision,
  arg_min(failure_recall, (cost_per_txn, threshold)) AS failure_recall FROM swf GROUP BY mult""")
def q_cost_sensitivity(c: Ctx) -> DataFrame:
    """Best threshold per cost multiplier 0.5..10, one scan."""
    sw = EV.sweep(_part(c, "validation"), EV.cost_sweep_thresholds(), multipliers=C.COST_MULTIPLIERS)
    return EV.best_by_cost(sw).select("mult", "threshold", "cost_per_txn", "failure_precision", "failure_recall")


@register_e("ranked_thresholds", """
SELECT threshold, round(cost_per_txn, 4) AS cost_per_txn, round(total_cost, 2) AS total_cost,
  row_number() OVER (ORDER BY round(cost_per_txn, 4), threshold) AS cost_rank FROM swf WHERE mult = 1.0""")
def q_ranked_thresholds(c: Ctx) -> DataFrame:
    """K3: sweep ranked by cost rounded to 4 dp (27 rows)."""
    from pyspark.sql import Window
    sw = EV.sweep(_part(c, "validation"), EV.cost_sweep_thresholds())
    r = sw.select("threshold", F.round("cost_per_txn", 4).alias("cost_per_txn"), F.round("total_cost", 2).alias("total_cost"))
    return r.withColumn("cost_rank", F.row_number().over(Window.orderBy("cost_per_txn", "threshold")).cast("long"))


@register_e("constrained_cost_threshold", """
SELECT arg_min(threshold, (cost_per_txn, threshold)) AS threshold, min(cost_per_txn) AS cost_per_txn,
  arg_min(failure_recall, (cost_per_txn, threshold)) AS failure_recall
FROM swf WHERE mult = 1.0 AND failure_recall >= 0.5 HAVING count(*) > 0""")
def q_constrained_cost_threshold(c: Ctx) -> DataFrame:
    """Cheapest threshold with failure recall >= 0.50 (no row if none)."""
    sw = EV.sweep(_part(c, "validation"), EV.cost_sweep_thresholds())
    return EV.constrained_cost_threshold(sw).select("threshold", "cost_per_txn", "failure_recall")


@register_e("pr_curve", "SELECT threshold, precision, recall FROM pr")
def q_pr_curve(c: Ctx) -> DataFrame:
    """Failure-class precision/recall at every distinct failure score (validation)."""
    return EV.pr_curve(_part(c, "validation"))


@register_e("best_f1_threshold", """
SELECT arg_max(threshold, (2*precision*recall/(precision+recall+1e-12), -threshold)) AS threshold,
  arg_max(precision, (2*precision*recall/(precision+recall+1e-12), -threshold)) AS precision,
  arg_max(recall, (2*precision*recall/(precision+recall+1e-12), -threshold)) AS recall,
  max(2*precision*recall/(precision+recall+1e-12)) AS f1 FROM pr""")
def q_best_f1_threshold(c: Ctx) -> DataFrame:
    """Argmax F1 on the PR curve, ties -> lowest threshold."""
    return EV.best_f1_threshold(EV.pr_curve(_part(c, "validation")))


@register_e("target_recall_threshold", """
SELECT arg_max(threshold, (precision, threshold)) AS threshold, max(precision) AS precision,
  arg_max(recall, (precision, threshold)) AS recall FROM pr WHERE recall >= 0.5 HAVING count(*) > 0""")
def q_target_recall_threshold(c: Ctx) -> DataFrame:
    """Recall >= 0.50 -> max precision, ties -> higher threshold."""
    return EV.target_recall_threshold(EV.pr_curve(_part(c, "validation")))


@register_e("roc_auc", """
SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*) AS roc_auc
FROM tst a JOIN tst b ON a.success = 1 AND b.success = 0""")
def q_roc_auc(c: Ctx) -> DataFrame:
    """Rank AUC (ties half) of p on the test part."""
    return EV.roc_auc(_part(c, "test"))


@register_e("average_precision", """
SELECT sum(pos * tps / (tps + fps)) / sum(pos) AS average_precision FROM (
 SELECT pos, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM
 (SELECT p, count_if(success = 1) AS pos, count_if(success = 0) AS neg FROM tst GROUP BY p)
 WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def q_average_precision(c: Ctx) -> DataFrame:
    """Step-wise average precision of the success class."""
    return EV.average_precision(_part(c, "test"))


@register_e("brier", f"""
SELECT avg(pow(p - success, 2)) AS brier,
  avg(-(success * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
      + (1 - success) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) AS log_loss,
  avg(CAST(CAST(NOT (1.0 - p >= 0.5) AS INT) = success AS DOUBLE)) AS accuracy FROM tst""")
def q_brier(c: Ctx) -> DataFrame:
    """Brier score, clipped log loss and accuracy at 0.5."""
    return EV.proper_scores(_part(c, "test"))


@register_e("evaluate", None)
def q_evaluate(c: Ctx) -> DataFrame:
    """ROC-AUC, AP, log loss, Brier, accuracy and failure P/R/F1 on one materialised scored frame."""
    return EV.metric_bundle(_part(c, "test"), EVAL_THRESHOLD)


ORACLE["evaluate"] = with_eval(f"""
SELECT 'roc_auc' AS metric, (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*)
  FROM tst a JOIN tst b ON a.success = 1 AND b.success = 0) AS value
UNION ALL SELECT 'average_precision', (SELECT sum(pos * tps / (tps + fps)) / sum(pos) FROM (
 SELECT pos, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM
 (SELECT p, count_if(success = 1) AS pos, count_if(success = 0) AS neg FROM tst GROUP BY p)
 WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
UNION ALL SELECT 'log_loss', (SELECT avg(-(success * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
      + (1 - success) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) FROM tst)
UNION ALL SELECT 'brier', (SELECT avg(pow(p - success, 2)) FROM tst)
UNION ALL SELECT 'accuracy', (SELECT avg(CAST(CAST(NOT (1.0 - p >= {EVAL_THRESHOLD}) AS INT) = success AS DOUBLE)) FROM tst)
UNION ALL SELECT 'failure_precision', (SELECT CASE WHEN count_if(1.0-p >= {EVAL_THRESHOLD}) > 0
  THEN count_if(success=0 AND 1.0-p >= {EVAL_THRESHOLD}) / count_if(1.0-p >= {EVAL_THRESHOLD}) ELSE 0.0 END FROM tst)
UNION ALL SELECT 'failure_recall', (SELECT CASE WHEN count_if(success=0) > 0
  THEN count_if(success=0 AND 1.0-p >= {EVAL_THRESHOLD}) / count_if(success=0) ELSE 0.0 END FROM tst)
UNION ALL SELECT 'failure_f1', (SELECT CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END FROM
  (SELECT count_if(success=0 AND 1.0-p >= {EVAL_THRESHOLD}) tp, count_if(success=1 AND 1.0-p >= {EVAL_THRESHOLD}) fp,
          count_if(success=0 AND NOT 1.0-p >= {EVAL_THRESHOLD}) fn FROM tst))""")


@register("incident_episodes", """
SELECT route_id, min(tick) AS start_tick, max(tick) AS end_tick, count(*) AS duration FROM
 (SELECT route_id, tick, tick - row_number() OVER (PARTITION BY route_id ORDER BY tick) AS g FROM rlive WHERE route_flagged_down = 1.0)
GROUP BY route_id, g""")
def q_incident_episodes(c: Ctx) -> DataFrame:
    """Contiguous flagged ticks per route (semi-dense spine vs dense oracle)."""
    return EV.incident_episodes(c.state.route)


@register("order_features", "SELECT txn_id, row_number() OVER (ORDER BY tick, txn_id) - 1 AS position FROM attempts")
def q_order_features(c: Ctx) -> DataFrame:
    """K1: position in the total order (tick, txn_id) without a single-task sort."""
    from routewise.operators.prefix import global_position
    return global_position(c.attempts.select("txn_id", "tick"), "tick", "txn_id", c.block_size).select(
        "txn_id", "position")


@register("concat_groups", "SELECT route_id, tick, route_success_rate_5m FROM rlive WHERE active")
def q_concat_groups(c: Ctx) -> DataFrame:
    """The union of all per-route frames, as one plan grouped by route."""
    return _route_cols(c, "route_success_rate_5m")


@register("dedup_first", "SELECT route_id, tick, arg_min(amount, txn_id) AS amount FROM attempts GROUP BY route_id, tick")
def q_dedup_first(c: Ctx) -> DataFrame:
    """Drop duplicate keys keeping the first row in txn order (order-aware)."""
    return CD.lookup_first_in_tick(c.attempts, ["route_id"], "amount")


# ------------------------------------------------------------ data quality
from routewise.operators import quality as QA  # noqa: E402

HORIZON_TICKS = 30 * 24   # 30 days of hourly ticks


@register("validate_attempts", f"""
SELECT rule, violations FROM (SELECT
  count_if(a.route_id NOT IN (SELECT route_id FROM routes)) AS unknown_route_id,
  count_if(a.tick < 0) AS negative_tick,
  count_if(a.tick >= {HORIZON_TICKS}) AS tick_beyond_horizon,
  count_if(a.network NOT IN (SELECT DISTINCT network FROM elig)) AS unsupported_network FROM attempts a)
UNPIVOT (violations FOR rule IN (unknown_route_id, negative_tick, tick_beyond_horizon, unsupported_network))""")
def q_validate_attempts(c: Ctx) -> DataFrame:
    """Q1: unknown route, negative tick, tick beyond horizon, unsupported network."""
    return QA.validate_attempts(c.attempts, c.routes, HORIZON_TICKS)


@register("null_profile", "SELECT column_name, n_null FROM (SELECT " + ", ".join(
    f"count_if({x} IS NULL) AS {x}" for x in C.FEATURE_TABLE_COLUMNS) + " FROM ft) UNPIVOT (n_null FOR column_name IN ("
    + ", ".join(C.FEATURE_TABLE_COLUMNS) + "))")
def q_null_profile(c: Ctx) -> DataFrame:
    """Q2: nulls per column of the 28-column feature table."""
    return QA.null_profile(c.features(False))


@register("split_counts", "SELECT dataset_split, count(*) AS n FROM ft GROUP BY dataset_split")
def q_split_counts(c: Ctx) -> DataFrame:
    """Q3: rows per dataset_split."""
    return QA.split_counts(c.features(False))


@register("write_features", "SELECT " + ", ".join(C.FEATURE_TABLE_COLUMNS) + " FROM ft")
def q_write_features(c: Ctx) -> DataFrame:
    """SNK1: write sorted + split-partitioned parquet, read it back."""
    from routewise.sources.sinks import read_features, shared_path, write_features
    path = shared_path(c.spark, "features")
    write_features(c.features(False), path)
    return read_features(c.spark, path).select(*C.FEATURE_TABLE_COLUMNS)


# ------------------------------------------------------------------ Spark ML
from pyspark.ml import Pipeline  # noqa: E402

from routewise.operators import learn as LN  # noqa: E402


def _prep(c: Ctx) -> "LN.Prepared":
    if not hasattr(c, "_prep"):
        c._prep = LN.Prepared(scored(c, engineered=True))
    return c._prep


def _model(c: Ctx):
    if not hasattr(c, "_model"):
        c._model = LN.fit(_prep(c), LN.QUERY_ROUNDS)
    return c._model


def _calibrated(c: Ctx):
    if not hasattr(c, "_cal"):
        c._cal = LN.calibrate(_model(c), _prep(c))
    return c._cal


@register_e("impute_median", "SELECT feature, median FROM (SELECT " + ", ".join(
    f"median({x}) AS {x}" for x in C.NUMERIC_FEATURES) + " FROM trn) UNPIVOT (median FOR feature IN ("
    + ", ".join(C.NUMERIC_FEATURES) + "))")
def q_impute_median(c: Ctx) -> DataFrame:
    """M1: exact (interpolated) training medians of the 26 numeric inputs, distributed."""
    tr = scored(c, engineered=True).where(F.col("split3") == "train")
    return LN.exact_median(tr, C.NUMERIC_FEATURES)


@register_e("impute_mode", "SELECT feature, arg_min(value, (-n, value)) AS mode FROM (SELECT feature, value, count(*) AS n FROM ("
            + " UNION ALL ".join(f"SELECT '{x}' AS feature, CAST({x} AS VARCHAR) AS value FROM trn" for x in C.CATEGORICAL_FEATURES)
            + ") GROUP BY feature, value) GROUP BY feature")
def q_impute_mode(c: Ctx) -> DataFrame:
    """M2: most frequent training value per categorical input, ties -> smallest."""
    tr = scored(c).where(F.col("split3") == "train")
    return LN.mode_values(tr, C.CATEGORICAL_FEATURES)


def _slots() -> str:
    return ", ".join(f"{x}_s AS (SELECT {x}, row_number() OVER (ORDER BY {x}) AS {x}_slot FROM (SELECT DISTINCT {x} FROM trn))"
                     for x in C.CATEGORICAL_FEATURES)


@register_e("one_hot", "SELECT txn_id, " + ", ".join(f"{x}_slot" for x in C.CATEGORICAL_FEATURES) + " FROM (WITH " + _slots()
            + " SELECT * FROM fe " + " ".join(f"LEFT JOIN {x}_s USING ({x})" for x in C.CATEGORICAL_FEATURES) + ")")
def q_one_hot(c: Ctx) -> DataFrame:
    """M3: StringIndexer(keep) + OneHotEncoder(dropLast): unseen category -> all-zero block."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    prep = _prep(c)
    cats = list(C.CATEGORICAL_FEATURES)
    idx = StringIndexer(inputCols=cats, outputCols=[f"{x}__idx" for x in cats], handleInvalid="keep",
                        stringOrderType="alphabetAsc").fit(prep.train)
    ohe = OneHotEncoder(inputCols=[f"{x}__idx" for x in cats], outputCols=[f"{x}__vec" for x in cats],
                        dropLast=True, handleInvalid="keep").fit(idx.transform(prep.train))
    out = ohe.transform(idx.transform(prep.all))
    from pyspark.ml.functions import vector_to_array
    return out.select("txn_id", *[F.array_position(vector_to_array(f"{x}__vec"), 1.0).alias(f"{x}_slot") for x in cats])


@register_e("assemble", "SELECT txn_id, (" + " + ".join(
    ["26", *(f"(SELECT count(DISTINCT {x}) + 1 FROM trn)" for x in C.CATEGORICAL_FEATURES)]) + ")::INT AS vector_size, ("
    + " + ".join(["7", *(f"CAST(coalesce({x}, (SELECT median({x}) FROM trn)) <> 0 AS INT)" for x in C.NUMERIC_FEATURES)])
    + ")::INT AS non_zeros FROM fe")
def q_assemble(c: Ctx) -> DataFrame:
    """M4: numeric + one-hot blocks assembled into one vector (size and non-zeros per row)."""
    from pyspark.ml.functions import vector_to_array
    m = _model(c)
    prep = _prep(c)
    x = m.stages[0].transform(prep.all)
    for st in m.stages[1:-1]:
        x = st.transform(x)
    arr = vector_to_array("features")
    return x.select("txn_id", F.size(arr).alias("vector_size"),
                    F.size(F.filter(arr, lambda v: v != 0)).alias("non_zeros"))


@register("train_baseline")
def q_train_baseline(c: Ctx) -> DataFrame:
    """M5: the unweighted baseline on its 15 + 7 inputs, without early stopping; P(success) for every test row."""
    m = LN.fit_baseline(_prep(c), LN.QUERY_ROUNDS)
    return LN.raw_scores(m, _prep(c).test).select("txn_id", "raw_p")


@register("train_candidate")
def q_train_candidate(c: Ctx) -> DataFrame:
    """M7: weighted boosted trees with validation early stopping, scored by validation cost."""
    m = _model(c)
    cost = LN.validation_cost(m, _prep(c))
    gbt = m.stages[-1]
    return c.spark.createDataFrame([(gbt.getNumTrees, cost)], "num_trees int, best_validation_cost_per_txn double")


@register("tune")
def q_tune(c: Ctx) -> DataFrame:
    """M8: 20 seeded random draws, fitted concurrently; sorted by validation cost."""
    rows = LN.tune(_prep(c), n_iter=20, params=LN.QUERY_ROUNDS)
    cols = sorted(LN.SEARCH_SPACE)
    data = [tuple([r["candidate"], r["validation_cost"]] + [str(r[k]) for k in cols]) for r in rows]
    schema = "candidate int, validation_cost double, " + ", ".join(f"{k} string" for k in cols)
    return c.spark.createDataFrame(data, schema)


@register("feature_importance")
def q_feature_importance(c: Ctx) -> DataFrame:
    """M9: model importances with assembled-vector names."""
    return LN.feature_importance(c.spark, _model(c), _prep(c).train)


@register("importance_share")
def q_importance_share(c: Ctx) -> DataFrame:
    """Importance summed by feature and percent of total."""
    return LN.importance_share(LN.feature_importance(c.spark, _model(c), _prep(c).train))


@register("top_importance")
def q_top_importance(c: Ctx) -> DataFrame:
    """K2: top 30 features by importance."""
    return LN.top_importance(LN.feature_importance(c.spark, _model(c), _prep(c).train), 30)


@register("calibrate_isotonic")
def q_calibrate_isotonic(c: Ctx) -> DataFrame:
    """Isotonic fit on validation raw scores, applied to test (clipped at the ends)."""
    return LN.score(_model(c), _calibrated(c), _prep(c).test).select("txn_id", "raw_p", "p", "success")


@register("calibration_gain")
def q_calibration_gain(c: Ctx) -> DataFrame:
    """Brier before vs after calibration, one aggregate."""
    s = LN.score(_model(c), _calibrated(c), _prep(c).test)
    y = F.col("success").cast("double")
    return s.agg(F.avg(F.pow(F.col("raw_p") - y, 2)).alias("brier_before"),
                 F.avg(F.pow(F.col("p") - y, 2)).alias("brier_after"))


_ISOTONIC_SQL = """
, xs AS (SELECT p AS x, count(*) AS n, sum(success) AS k, row_number() OVER (ORDER BY p) AS i FROM val GROUP BY p),
cs AS (SELECT i, x, sum(n) OVER (ORDER BY i) AS cn, sum(k) OVER (ORDER BY i) AS ck, n, k FROM xs),
least_mean AS (SELECT a.i AS a, b.i AS b, min((b.ck - a.ck + a.k) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m
  FROM cs a JOIN cs b ON b.i >= a.i),
fitted AS (SELECT x, f FROM cs JOIN (SELECT b, max(m) AS f FROM least_mean GROUP BY b) ON b = i),
low AS (SELECT t.txn_id, t.p, t.success, f.x AS x0, f.f AS f0 FROM tst t ASOF LEFT JOIN fitted f ON f.x <= t.p),
ends AS (SELECT l.*, f.x AS x1, f.f AS f1 FROM low l ASOF LEFT JOIN fitted f ON f.x >= l.p),
cal AS (SELECT txn_id, p AS raw_p, success, CASE WHEN x0 IS NULL THEN f1 WHEN x1 IS NULL OR x1 = x0 THEN f0
  ELSE f0 + (f1 - f0) * (p - x0) / (x1 - x0) END AS p FROM ends)
"""


def _calibrated_score(c: Ctx) -> DataFrame:
    fitted = LN.isotonic(_part(c, "validation").withColumn("label", F.col("success").cast("double")).withColumnRenamed("p", "raw_p"), "raw_p", "label")
    return fitted.transform(_part(c, "test").withColumnRenamed("p", "raw_p")).select("txn_id", "raw_p", "p", "success")


@register_e("calibrate_isotonic_score", _ISOTONIC_SQL + "SELECT txn_id, raw_p, p, success FROM cal")
def q_calibrate_isotonic_score(c: Ctx) -> DataFrame:
    """M10 on the SQL-expressible score: isotonic fit on validation, applied to test (interpolated, clipped at the ends)."""
    return _calibrated_score(c)


@register_e("calibration_gain_score", _ISOTONIC_SQL + "SELECT avg((raw_p - success) ** 2) AS brier_before, avg((p - success) ** 2) AS brier_after FROM cal")
def q_calibration_gain_score(c: Ctx) -> DataFrame:
    """M14 on the SQL-expressible score: Brier before and after calibration, one aggregate."""
    return _calibrated_score(c).agg(F.avg(F.pow(F.col("raw_p") - F.col("success"), 2)).alias("brier_before"),
                                    F.avg(F.pow(F.col("p") - F.col("success"), 2)).alias("brier_after"))


_DIFFERENCE_SQL = ("SELECT feature, importance FROM (SELECT " + ", ".join(
    f"coalesce(abs(avg({x}) FILTER (success = 1) - avg({x}) FILTER (success = 0)) / nullif(stddev_pop({x}), 0), 0) AS {x}" for x in C.NUMERIC_FEATURES)
    + " FROM trn) UNPIVOT (importance FOR feature IN (" + ", ".join(C.NUMERIC_FEATURES) + "))")
_SHARE_SQL = f"SELECT feature, importance, importance / sum(importance) OVER () * 100.0 AS importance_pct FROM ({_DIFFERENCE_SQL})"


def _difference(c: Ctx) -> DataFrame:
    return LN.class_difference(scored(c, engineered=True).where(F.col("split3") == "train"), C.NUMERIC_FEATURES)


@register_e("importance_share_difference", _SHARE_SQL)
def q_importance_share_difference(c: Ctx) -> DataFrame:
    """G18 on importances without a model (distance of the classes' means): percent of the total."""
    return LN.importance_share(_difference(c))


@register_e("top_importance_difference", f"SELECT * FROM ({_SHARE_SQL}) ORDER BY importance DESC, feature LIMIT 10")
def q_top_importance_difference(c: Ctx) -> DataFrame:
    """K2 on importances without a model: the top 10 inputs."""
    return LN.top_importance(_difference(c), 10)


@register_e("write_importance_difference", _SHARE_SQL)
def q_write_importance_difference(c: Ctx) -> DataFrame:
    """SNK2 on importances without a model: written as CSV (header) and read back."""
    from routewise.sources.sinks import shared_path, write_csv
    path = shared_path(c.spark, "importance")
    write_csv(LN.importance_share(_difference(c)), path)
    return c.spark.read.option("header", True).schema("feature string, importance double, importance_pct double").csv(path)


@register_e("feature_slots", "SELECT row_number() OVER (ORDER BY block, value) - 1 AS slot, feature FROM ("
            + " UNION ALL ".join([f"SELECT {i} AS block, NULL AS value, '{x}' AS feature" for i, x in enumerate(C.NUMERIC_FEATURES)]
                                 + [f"SELECT DISTINCT {100 + i}, {x}, '{x}_' || {x} FROM trn UNION ALL SELECT {100 + i}, '~', '{x}___unknown'"
                                    for i, x in enumerate(C.CATEGORICAL_FEATURES)]) + ")")
def q_feature_slots(c: Ctx) -> DataFrame:
    """M9, the names of the assembled vector's slots: numeric inputs, then every input's categories in order and one for unknown ones."""
    prep = _prep(c)
    assembled = LN.build_pipeline(params=LN.BASE_PARAMS).getStages()[:-1]
    names = LN.encoded_names(Pipeline(stages=assembled).fit(prep.train), prep.train)
    return c.spark.createDataFrame(list(enumerate(names)), "slot long, feature string")


@register("model_evaluate")
def q_model_evaluate(c: Ctx) -> DataFrame:
    """M13 with the trained, calibrated model: AUC, AP, log loss, Brier, accuracy, failure P/R/F1."""
    from routewise.plans.materialize import checkpointed
    s = checkpointed(LN.score(_model(c), _calibrated(c), _prep(c).test)
                     .select("p", "success", "amount", "route_cost_percent"), "model_scores")
    return EV.metric_bundle(s, EVAL_THRESHOLD)


@register("score_candidates")
def q_score_candidates(c: Ctx) -> DataFrame:
    """Calibrated P(success) for every (test transaction x eligible route)."""
    cands = candidates(c)
    return LN.score(_model(c), _calibrated(c), cands).select("txn_id", "route_id", "raw_p", "p")


@register("policy_report_model")
def q_policy_report_model(c: Ctx) -> DataFrame:
    """M15 with the model: argmax over calibrated scores (ties: raw p, route order)."""
    scored_c = LN.score(_model(c), _calibrated(c), candidates(c))
    return PL.policy_summary(scored_c, c.eligibility, "p", "raw_p").drop("candidate_rows")


@register("write_importance")
def q_write_importance(c: Ctx) -> DataFrame:
    """SNK2: importance table written as CSV (header) and read back."""
    from routewise.sources.sinks import shared_path, write_csv
    path = shared_path(c.spark, "importance")
    write_csv(LN.importance_share(LN.feature_importance(c.spark, _model(c), _prep(c).train)), path)
    return c.spark.read.option("header", True).schema("feature string, importance double, importance_pct double").csv(path)


@register("save_pipeline")
def q_save_pipeline(c: Ctx) -> DataFrame:
    """SNK3: persist pipeline + calibrator + threshold metadata, reload, score test rows."""
    from routewise.sources.sinks import shared_path
    path = shared_path(c.spark, "pipeline")
    LN.save_pipeline(_model(c), _calibrated(c), path, EVAL_THRESHOLD)
    model, cal, meta = LN.load_pipeline(c.spark, path)
    s = LN.score(model, cal, _prep(c).test)
    return s.select("txn_id", "raw_p", "p", F.lit(meta["threshold"]).alias("threshold"))


# ----------------------------------------------------------------- streaming
from routewise.streaming import features as SF  # noqa: E402
from routewise.streaming import sources as SS  # noqa: E402
from routewise.streaming.runner import dropped_by_watermark, run_available_now  # noqa: E402

TICK = 3600


def _decisions(c: Ctx, gaps: bool = False) -> DataFrame:
    """The stream of decisions alone, for queries that read no outcomes."""
    from routewise.sources.bindings import read_attempts
    a = read_attempts(c.spark, c.sf_dir, c.tick_seconds, with_ts=True)
    return SS.read_decisions(c.spark, SS.materialise_decisions(c.spark, a, gaps))


def _outcomes(c: Ctx, gaps: bool = False) -> DataFrame:
    """The stream of outcomes alone, for queries that read no decisions."""
    from routewise.sources.bindings import read_attempts
    a = read_attempts(c.spark, c.sf_dir, c.tick_seconds, with_ts=True)
    return SS.read_outcomes(c.spark, SS.materialise_outcomes(c.spark, a, gaps))


def _streams(c: Ctx, gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    return _decisions(c, gaps), _outcomes(c, gaps)


def _stream_ctes(gaps: bool) -> str:
    no_decision, no_outcome = ("WHERE txn_id % 50 <> 1", "WHERE txn_id % 50 <> 0") if gaps else ("", "")
    return f"""
, dec AS (SELECT txn_id, ts AS decision_ts, tick, bank, network, route_id FROM attempts {no_decision}),
outc AS (SELECT txn_id, ts AS attempt_ts, ts + to_minutes(CAST(latency_ms AS INT)) AS outcome_ts, tick, bank, network,
  route_id, success, latency_ms FROM attempts {no_outcome}),
sev AS (SELECT tick, bank, network, route_id, 1 AS req, 0 AS att, 0 AS succ, 0.0::DOUBLE AS lat FROM dec
  UNION ALL SELECT tick, bank, network, route_id, 0, 1, success, latency_ms FROM outc)
"""


def _bucket_sql() -> str:
    aggs = ("CAST(sum(req) AS BIGINT) AS requests, CAST(sum(att) AS BIGINT) AS attempts, "
            "CAST(sum(succ) AS BIGINT) AS successes, sum(lat) AS latency_sum")
    parts = [("route", "NULL", "route_id", "NULL", "route_id"), ("bank", "bank", "NULL", "NULL", "bank"),
             ("network", "NULL", "NULL", "network", "network"), ("bank_route", "bank", "route_id", "NULL", "bank, route_id"),
             ("global", "NULL", "NULL", "NULL", None)]
    sel = []
    for name, b, r, n, g in parts:
        grp = f"GROUP BY {g}, tick" if g else "GROUP BY tick"
        sel.append(f"SELECT '{name}' AS scope, CAST({b} AS VARCHAR) AS bank, CAST({r} AS VARCHAR) AS route_id, "
                   f"CAST({n} AS VARCHAR) AS network, tick, {aggs} FROM sev {grp}")
    return " UNION ALL ".join(sel)


def register_s(key: str, sql: str | None = None, gaps: bool = False):
    """Register a query on the streams; with ``gaps`` some decisions and outcomes never arrive."""
    def deco(fn):
        register(key)(fn)
        if sql is not None:
            from routewise.plans.oracle import BASE_CTES
            ORACLE[key] = "WITH " + BASE_CTES.strip() + "\n" + _stream_ctes(gaps).strip() + "\n" + sql.strip()
        return fn
    return deco


@register_s("decision_outcome_join", """
SELECT d.txn_id, d.route_id, o.success FROM dec d JOIN outc o ON o.txn_id = d.txn_id
 AND o.outcome_ts >= d.decision_ts AND o.outcome_ts <= d.decision_ts + INTERVAL 1 HOUR""", gaps=True)
def q_decision_outcome_join(c: Ctx) -> DataFrame:
    """Pending decision joined with its (deduplicated) outcome within the 1 h TTL (batch form)."""
    from routewise.sources.bindings import attempts_from_events
    at = attempts_from_events(c.table("events"), c.tick_seconds)
    d, o = SS.decisions(at, True), SS.outcomes(at, True).dropDuplicates(["txn_id"])
    j = d.alias("d").join(o.alias("o"), (F.col("d.txn_id") == F.col("o.txn_id"))
                          & (F.col("o.outcome_ts") >= F.col("d.decision_ts"))
                          & (F.col("o.outcome_ts") <= F.col("d.decision_ts") + F.expr("INTERVAL 1 HOUR")))
    return j.select(F.col("d.txn_id").alias("txn_id"), F.col("d.route_id").alias("route_id"), F.col("o.success"))


@register_s("orphan_outcomes", """
SELECT DISTINCT o.txn_id FROM outc o WHERE NOT EXISTS (SELECT 1 FROM dec d WHERE d.txn_id = o.txn_id)""", gaps=True)
def q_orphan_outcomes(c: Ctx) -> DataFrame:
    """Outcomes with no pending decision (HTTP 404 online) -- left anti-join."""
    from routewise.sources.bindings import attempts_from_events
    at = attempts_from_events(c.table("events"), c.tick_seconds)
    return SS.outcomes(at, True).join(SS.decisions(at, True), "txn_id", "left_anti").select("txn_id").distinct()


COLD = ("route_success_rate_5m", "route_success_rate_15m", "route_avg_latency_5m", "route_failure_rate_1m",
        "bank_failure_rate_5m", "network_failure_rate_5m", "amount_to_bank_avg_ratio")
DERIVED = ("route_failure_rate_5m", "route_failure_rate_15m", "route_success_drop_5m", "route_success_drop_15m",
           "route_latency_ratio", "bank_route_gap", "route_stress")


@register_c("cold_start_fill", """
SELECT txn_id, route_id, s5 AS route_success_rate_5m, s15 AS route_success_rate_15m, l5 AS route_avg_latency_5m,
  f1 AS route_failure_rate_1m, b5 AS bank_failure_rate_5m, n5 AS network_failure_rate_5m, ar AS amount_to_bank_avg_ratio,
  1.0 - s5 AS route_failure_rate_5m, 1.0 - s15 AS route_failure_rate_15m,
  route_base_success_rate - s5 AS route_success_drop_5m, route_base_success_rate - s15 AS route_success_drop_15m,
  l5 / (route_base_latency_ms + 0.000001) AS route_latency_ratio, bank_route_success_rate_15m - s15 AS bank_route_gap,
  route_utilization * (1.0 - s15) AS route_stress
FROM (SELECT c.*, coalesce(route_success_rate_5m, ro.base_success_rate) AS s5,
  coalesce(route_success_rate_15m, ro.base_success_rate) AS s15,
  coalesce(route_avg_latency_5m, CAST(ro.base_latency_ms AS DOUBLE)) AS l5,
  coalesce(route_failure_rate_1m, 1.0 - ro.base_success_rate) AS f1, coalesce(bank_failure_rate_5m, 0.0) AS b5,
  coalesce(network_failure_rate_5m, 0.0) AS n5, coalesce(amount_to_bank_avg_ratio, 1.0) AS ar
  FROM cands c JOIN routes ro USING (route_id))""")
def q_cold_start_fill(c: Ctx) -> DataFrame:
    """ST13: online cold-start fallbacks from static route config, and the engineered columns that follow from them."""
    x = candidates(c).drop(*DERIVED).join(
        F.broadcast(c.routes.select("route_id", "base_success_rate", "base_latency_ms")), "route_id")
    x = x.withColumns(dict(zip(COLD, (
        F.coalesce("route_success_rate_5m", "base_success_rate"), F.coalesce("route_success_rate_15m", "base_success_rate"),
        F.coalesce("route_avg_latency_5m", F.col("base_latency_ms").cast("double")),
        F.coalesce("route_failure_rate_1m", 1.0 - F.col("base_success_rate")),
        F.coalesce("bank_failure_rate_5m", F.lit(0.0)), F.coalesce("network_failure_rate_5m", F.lit(0.0)),
        F.coalesce("amount_to_bank_avg_ratio", F.lit(1.0))))))
    return FT.add_engineered(x).select("txn_id", "route_id", *COLD, *DERIVED)


@register_s("stream_minute_buckets", _bucket_sql())
def q_stream_minute_buckets(c: Ctx) -> DataFrame:
    """ST1: five-scope tick buckets from the live streams (update mode, latest per key)."""
    d, o = _streams(c)
    res, _ = run_available_now(c.spark, SF.minute_buckets(d, o, c.tick_seconds), "st1",
                               keys=["scope", "bank", "route_id", "network", "tick"])
    return res


@register_s("stream_rolling_rates", """
SELECT route_id, m AS tick, sum(CASE WHEN off <= 5 THEN k END) / sum(CASE WHEN off <= 5 THEN n END) AS route_success_rate_5m,
  sum(k) / sum(n) AS route_success_rate_15m,
  sum(CASE WHEN off <= 5 THEN lat END) / sum(CASE WHEN off <= 5 THEN n END) AS route_avg_latency_5m,
  CAST(sum(CASE WHEN off = 1 THEN n ELSE 0 END) AS DOUBLE) AS route_requests_1m
FROM (SELECT c.route_id, c.tick + d.off AS m, d.off, c.n, c.k, c.lat FROM
  (SELECT route_id, tick, count(*) AS n, sum(success) AS k, sum(latency_ms) AS lat FROM outc GROUP BY route_id, tick) c
  CROSS JOIN (SELECT unnest(range(1, 16)) AS off) d)
GROUP BY route_id, m""")
def q_stream_rolling_rates(c: Ctx) -> DataFrame:
    """ST3: trailing 15-, 5- and 1-tick route rates from one sliding window (window end = feature tick)."""
    o = _outcomes(c)
    res, _ = run_available_now(c.spark, SF.rolling_rates(o, c.tick_seconds), "st3", keys=["route_id", "tick"])
    return res


@register("stream_last_flagged", """
SELECT r.route_id, r.tick, r.route_success_rate_5m, r.route_flagged_down, r.time_since_last_failure FROM rlive r
JOIN (SELECT route_id, min(tick) AS lo, max(tick) AS hi FROM rcell GROUP BY route_id) b
  ON r.route_id = b.route_id AND r.tick BETWEEN b.lo AND b.hi""")
def q_stream_last_flagged(c: Ctx) -> DataFrame:
    """ST4: per-route incident state machine, one transition per closed tick, first to last active tick."""
    o = _outcomes(c)
    return SF.run_incident_state(c.spark, o, c.tick_seconds)


@register_s("stream_last_success",
            "SELECT bank, route_id, max(tick) AS last_success_tick FROM outc WHERE success = 1 GROUP BY bank, route_id")
def q_stream_last_success(c: Ctx) -> DataFrame:
    """ST5: last success tick per (bank, route)."""
    o = _outcomes(c)
    res, _ = run_available_now(c.spark, SF.last_success(o), "st5", keys=["bank", "route_id"])
    return res


@register_s("stream_decision_outcome", """
SELECT d.txn_id, d.route_id, o.success FROM dec d JOIN outc o ON o.txn_id = d.txn_id
 AND o.outcome_ts >= d.decision_ts AND o.outcome_ts <= d.decision_ts + INTERVAL 1 HOUR""", gaps=True)
def q_stream_decision_outcome(c: Ctx) -> DataFrame:
    """ST6: stream-stream join of decisions and outcomes within 1 h (both watermarked)."""
    d, o = _streams(c, gaps=True)
    res, _ = run_available_now(c.spark, SF.decision_outcome_join(d, o), "st6", output_mode="append")
    return res.select("txn_id", "route_id", "success")


@register_s("stream_expired_decisions", """
SELECT d.txn_id, d.route_id FROM dec d WHERE NOT EXISTS (SELECT 1 FROM outc o WHERE o.txn_id = d.txn_id
 AND o.outcome_ts >= d.decision_ts AND o.outcome_ts <= d.decision_ts + INTERVAL 1 HOUR)""", gaps=True)
def q_stream_expired_decisions(c: Ctx) -> DataFrame:
    """ST6, left outer form: decisions whose outcome did not come within 1 h."""
    d, o = _streams(c, gaps=True)
    res, _ = run_available_now(c.spark, SF.decision_outcome_join(d, o, how="left_outer"), "st6x", output_mode="append")
    return res.where(F.col("outcome_ts").isNull()).select("txn_id", "route_id")


@register_s("stream_dedup_outcomes", "SELECT txn_id, success FROM outc")
def q_stream_dedup_outcomes(c: Ctx) -> DataFrame:
    """ST7: idempotent outcomes (dropDuplicatesWithinWatermark on the attempt id)."""
    o = _outcomes(c)
    res, _ = run_available_now(c.spark, SF.dedup_outcomes(o).select("txn_id", "success"), "st7", output_mode="append")
    return res


@register_s("stream_late_credit", """
SELECT tick, count(*) AS outcomes, CAST(sum(success) AS BIGINT) AS successes, CAST(0 AS BIGINT) AS rows_dropped_by_watermark FROM outc GROUP BY tick""")
def q_stream_late_credit(c: Ctx) -> DataFrame:
    """ST8: outcomes credited to the attempt tick; no callback within the TTL is dropped, later ones are counted."""
    o = _outcomes(c)
    res, prog = run_available_now(c.spark, SF.late_credit(o, c.tick_seconds), "st8", keys=["tick"])
    return res.withColumn("rows_dropped_by_watermark", F.lit(dropped_by_watermark(prog)).cast("long"))


@register("stream_bank_amount", "SELECT a.txn_id, a.bank, t.amount_to_bank_avg_ratio FROM attempts a JOIN txnf t USING (txn_id)")
def q_stream_bank_amount(c: Ctx) -> DataFrame:
    """ST9: running per-bank amount totals carried from micro-batch to micro-batch, ratio read before add."""
    d = _decisions(c)
    return SF.run_bank_amount(c.spark, d, c.block_size)


@register_s("stream_system_tps", "SELECT tick + 1 AS tick, count(*) / 3600.0 AS system_tps FROM dec GROUP BY tick")
def q_stream_system_tps(c: Ctx) -> DataFrame:
    """ST10, coarse form: requests in the previous tick / tick length."""
    d = _decisions(c)
    res, _ = run_available_now(c.spark, SF.system_tps(d, c.tick_seconds), "st10", keys=["tick"])
    return res


@register_s("stream_ingress_meter", """
SELECT d.txn_id, count(o.txn_id) / 60.0 AS system_tps FROM dec d LEFT JOIN dec o
  ON floor(epoch(o.decision_ts)) >= floor(epoch(d.decision_ts)) - 60 AND floor(epoch(o.decision_ts)) < floor(epoch(d.decision_ts))
GROUP BY d.txn_id""")
def q_stream_ingress_meter(c: Ctx) -> DataFrame:
    """ST10: requests per second over the 60 completed seconds before each request, not counting itself."""
    d = _decisions(c)
    return SF.run_ingress_meter(c.spark, d)


@register_s("stream_close", """
, hit AS (SELECT d.txn_id, d.route_id FROM dec d JOIN outc o ON o.txn_id = d.txn_id
  AND o.outcome_ts >= d.decision_ts AND o.outcome_ts <= d.decision_ts + INTERVAL 1 HOUR)
SELECT txn_id, 'matched' AS closed, route_id FROM hit
UNION ALL SELECT txn_id, 'expired', route_id FROM dec WHERE txn_id NOT IN (SELECT txn_id FROM hit)
UNION ALL SELECT txn_id, 'orphan', route_id FROM outc WHERE txn_id NOT IN (SELECT txn_id FROM hit)""", gaps=True)
def q_stream_close(c: Ctx) -> DataFrame:
    """ST6 with J14: every decision and outcome closed as matched, expired or orphan by one stateful operator."""
    d, o = _streams(c, gaps=True)
    res, _ = run_available_now(c.spark, SF.close_decisions(d, o), "st6c", output_mode="append")
    return res.select("txn_id", "closed", "route_id")


#: Seconds of arrivals per micro-batch of the serving queries: 6 or 7 of them in the events' 30 days.
SLICE = 120 * 3600

_ARRIVALS_SQL = f"""
, came AS (SELECT 'outcome' AS kind, txn_id, tick, bank, network, route_id, success, latency_ms, ts + to_minutes(CAST(latency_ms AS INT)) AS came_at FROM attempts
  UNION ALL SELECT 'request', txn_id, tick, bank, network, route_id, NULL, NULL, ts FROM attempts),
arr AS (SELECT *, CAST(floor((epoch(came_at) - 1704067200) / 3600) AS BIGINT) AS arrived, CAST(floor((epoch(came_at) - 1704067200) / {SLICE}) AS BIGINT) AS slice FROM came),
slices AS (SELECT slice, row_number() OVER (ORDER BY slice) - 1 AS batch_id, max(high) OVER (ORDER BY slice) AS high
  FROM (SELECT slice, max(arrived) AS high FROM (SELECT slice, arrived FROM arr UNION ALL
    SELECT CAST(floor((epoch(came_at) + 1800 - 1704067200) / {SLICE}) AS BIGINT), NULL FROM arr WHERE kind = 'outcome' AND txn_id % 10 = 0) GROUP BY slice))
"""

_TTL_SQL = _ARRIVALS_SQL + """
, bucket AS (SELECT 'route' AS scope, route_id AS k1, NULL AS k2, tick, arrived FROM arr WHERE kind = 'outcome'
  UNION ALL SELECT 'bank', bank, NULL, tick, arrived FROM arr WHERE kind = 'outcome'
  UNION ALL SELECT 'network', network, NULL, tick, arrived FROM arr WHERE kind = 'outcome'
  UNION ALL SELECT 'bank_route', bank, route_id, tick, arrived FROM arr WHERE kind = 'outcome'
  UNION ALL SELECT 'global', NULL, NULL, tick, arrived FROM arr WHERE kind = 'request')
SELECT scope, k1, k2, tick, min(batch_id) AS batch_id
FROM (SELECT scope, k1, k2, tick, max(arrived) AS last FROM bucket GROUP BY scope, k1, k2, tick) b JOIN slices s ON s.high >= b.last + 30
GROUP BY scope, k1, k2, tick"""

_SNAPSHOT_SQL = _ARRIVALS_SQL + """
, cell AS (SELECT bank, network, route_id, tick, arrived, count(*) AS n, sum(success) AS k, sum(latency_ms) AS lat
  FROM arr WHERE kind = 'outcome' GROUP BY ALL),
m AS (SELECT unnest(range(total_ticks)) AS tick FROM bounds),
rate AS (SELECT r.route_id, m.tick, sum(n) AS n15, sum(k) AS k15, sum(n) FILTER (c.tick >= m.tick - 5) AS n5,
    sum(k) FILTER (c.tick >= m.tick - 5) AS k5, sum(lat) FILTER (c.tick >= m.tick - 5) AS l5
  FROM routes r CROSS JOIN m LEFT JOIN cell c ON c.route_id = r.route_id AND c.tick BETWEEN m.tick - 15 AND m.tick - 1 AND c.arrived < m.tick
  GROUP BY r.route_id, m.tick),
live AS (SELECT route_id, tick, k5 / n5 AS route_success_rate_5m, k15 / n15 AS route_success_rate_15m, l5 / n5 AS route_avg_latency_5m,
    CAST(coalesce(k5 / n5 < 0.7, false) AS DOUBLE) AS route_flagged_down,
    coalesce(CAST(tick - max(CASE WHEN k5 / n5 < 0.7 THEN tick END) OVER (PARTITION BY route_id ORDER BY tick
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 9999.0) AS time_since_last_failure FROM rate),
seen AS (SELECT 'route' AS scope, route_id AS key, m.tick AS m, c.tick, sum(n) AS n, sum(k) AS k FROM cell c JOIN m ON c.arrived < m.tick GROUP BY ALL
  UNION ALL SELECT 'bank', bank, m.tick, c.tick, sum(n), sum(k) FROM cell c JOIN m ON c.arrived < m.tick GROUP BY ALL
  UNION ALL SELECT 'network', network, m.tick, c.tick, sum(n), sum(k) FROM cell c JOIN m ON c.arrived < m.tick GROUP BY ALL),
active AS (SELECT scope, key, m AS tick, 1 - sum(k) / sum(n) AS failure_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, key, m ORDER BY tick DESC) AS nth FROM seen)
  WHERE nth <= CASE WHEN scope = 'route' THEN 1 ELSE 5 END GROUP BY scope, key, m),
pair AS (SELECT c.bank, c.route_id, m.tick, sum(n) FILTER (c.tick >= m.tick - 15) AS n, sum(k) FILTER (c.tick >= m.tick - 15) AS k,
    max(c.tick) FILTER (c.k > 0) AS last FROM cell c JOIN m ON c.arrived < m.tick GROUP BY ALL),
mean AS (SELECT a.bank, m.tick, avg(a.amount) AS amount FROM attempts a JOIN m ON a.tick < m.tick GROUP BY ALL),
shot AS (SELECT a.txn_id, a.tick, e.route_order, (a.tick*60 // 1440) % 7 AS day_in_week, (a.tick*60 % 1440) // 60 AS hour_of_day, a.amount,
  b.route_base_success_rate, b.route_base_latency_ms, r.route_cost_percent, l.route_success_rate_5m, l.route_success_rate_15m,
  l.route_avg_latency_5m, coalesce(g.n, 0) / 3600.0 * r.route_weight / r.base_capacity_tps AS route_utilization, coalesce(g.n, 0) / 3600.0 AS system_tps,
  l.time_since_last_failure, l.route_flagged_down,
  (coalesce(p.k, 0) + 10 * coalesce(b.route_base_success_rate, o.prior)) / (coalesce(p.n, 0) + 10) AS bank_route_success_rate_15m,
  bf.failure_rate AS bank_failure_rate_5m, nf.failure_rate AS network_failure_rate_5m, rf.failure_rate AS route_failure_rate_1m,
  coalesce(CAST(a.tick - p.last AS DOUBLE), 9999.0) AS time_since_last_bank_route_success,
  CASE WHEN mean.amount > 0 THEN a.amount / mean.amount END AS amount_to_bank_avg_ratio,
  a.bank, a.network, a.payment_method, a.merchant, a.device, a.risk, e.route_id
  FROM attempts a JOIN elig e USING (payment_method, network) JOIN routes r ON r.route_id = e.route_id CROSS JOIN overall o
  LEFT JOIN live l ON l.route_id = e.route_id AND l.tick = a.tick LEFT JOIN base b ON b.route_id = e.route_id
  LEFT JOIN gtot g ON g.tick = a.tick - 1 LEFT JOIN pair p ON p.bank = a.bank AND p.route_id = e.route_id AND p.tick = a.tick
  LEFT JOIN active bf ON bf.scope = 'bank' AND bf.key = a.bank AND bf.tick = a.tick
  LEFT JOIN active nf ON nf.scope = 'network' AND nf.key = a.network AND nf.tick = a.tick
  LEFT JOIN active rf ON rf.scope = 'route' AND rf.key = e.route_id AND rf.tick = a.tick
  LEFT JOIN mean ON mean.bank = a.bank AND mean.tick = a.tick)
SELECT *, 1.0 - route_success_rate_5m AS route_failure_rate_5m, 1.0 - route_success_rate_15m AS route_failure_rate_15m,
  route_base_success_rate - route_success_rate_5m AS route_success_drop_5m, route_base_success_rate - route_success_rate_15m AS route_success_drop_15m,
  route_avg_latency_5m / (route_base_latency_ms + 1e-6) AS route_latency_ratio, bank_route_success_rate_15m - route_success_rate_15m AS bank_route_gap,
  route_utilization * (1.0 - route_success_rate_15m) AS route_stress
FROM shot"""


def _frozen(c: Ctx) -> tuple[DataFrame, float | None]:
    """What a deployment starts with: the training baselines (one row per route of the dimension) and their mean."""
    _, train = FT.bounds(c.attempts)
    rows = FT.training_baselines(c.attempts, train, c.routes).collect()
    rates = [r["route_base_success_rate"] for r in rows]
    base = c.spark.createDataFrame([tuple(r) for r in rows], "route_id string, route_base_success_rate double, route_base_latency_ms double")
    return base, sum(rates) / len(rates) if rates else None


def serving(c: Ctx, answer=None, path: str | None = None, slice_seconds: int = SLICE) -> DataFrame:
    """The answers to all requests, replayed as a stream of arrivals, one slice per micro-batch."""
    from routewise.sources.bindings import read_attempts
    from routewise.sources.sinks import shared_path
    from routewise.streaming import serving as SV
    path = path or shared_path(c.spark, "serve")
    a = read_attempts(c.spark, c.sf_dir, c.tick_seconds, with_ts=True)
    # a file per core: every core writes and reads each slice
    source = SS.write_slices(SS.arrivals(a, c.tick_seconds, slice_seconds), shared_path(c.spark, "arrivals"),
                             c.spark.sparkContext.defaultParallelism)
    base, prior = _frozen(c)
    return SV.serve(c.spark, SS.read_arrivals(c.spark, source), c.eligibility, base, prior, c.tick_seconds, path, answer)


@register("stream_bucket_ttl", _TTL_SQL)
def q_stream_bucket_ttl(c: Ctx) -> DataFrame:
    """ST2: the buckets that leave the state, with the micro-batch in which they do (30 ticks after their last arrival)."""
    return serving(c, lambda requests, state, shot: state.where("part = 'evicted'").select("scope", "k1", "k2", "tick"))


@register("stream_feature_snapshot", _SNAPSHOT_SQL)
def q_stream_feature_snapshot(c: Ctx) -> DataFrame:
    """ST11: full 33-column vector per (request x eligible route) from the streams' own state, as of the request's tick."""
    return serving(c).drop("batch_id")


def _saved_pipeline(c: Ctx):
    from routewise.sources.sinks import shared_path
    path = shared_path(c.spark, "pipeline")
    LN.save_pipeline(_model(c), _calibrated(c), path, EVAL_THRESHOLD)
    return LN.load_pipeline(c.spark, path)


@register("stream_route")
def q_stream_route(c: Ctx) -> DataFrame:
    """ST12: candidates scored by the saved pipeline inside the micro-batch, argmax, one pending decision per request."""
    from routewise.streaming import serving as SV
    model, calibrator, _ = _saved_pipeline(c)
    r = serving(c, SV.decide(model, calibrator))
    return r.select("txn_id", F.col("route_id").alias("chosen_route_id"), "chosen_p", F.size("candidates").alias("n_candidates"))


# ------------------------------------------- G19 split keys, second binding
@register_e("log_loss", """
SELECT avg(-(success * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
      + (1 - success) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) AS log_loss FROM tst""")
def q_log_loss(c: Ctx) -> DataFrame:
    """Log loss with p clipped to [eps, 1 - eps]."""
    return EV.proper_scores(_part(c, "test")).select("log_loss")


@register_e("accuracy", "SELECT avg(CAST(CAST(NOT (1.0 - p >= 0.5) AS INT) = success AS DOUBLE)) AS accuracy FROM tst")
def q_accuracy(c: Ctx) -> DataFrame:
    """Accuracy of the 0.5 decision."""
    return EV.proper_scores(_part(c, "test")).select("accuracy")


ORDERS_ATTEMPTS = """
WITH oa AS (SELECT o.o_orderkey AS txn_id, CAST(floor(epoch(o.o_orderdate) / 86400) AS BIGINT) AS tick,
  o.o_totalprice AS amount, c.c_mktsegment AS bank, 'R' || CAST(1 + o.o_custkey % 4 AS VARCHAR) AS route_id,
  CAST(o.o_orderstatus <> 'F' AS INT) AS success
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)
"""


def _orders_attempts(c: Ctx) -> DataFrame:
    from routewise.sources.bindings import attempts_from_orders
    return attempts_from_orders(c.table("orders"), c.table("customer"))


QUERIES_SQL_ORDERS = ORDERS_ATTEMPTS + """
SELECT txn_id,
  coalesce(CAST(tick - last_value(CASE WHEN success = 1 THEN tick END IGNORE NULLS) OVER
    (PARTITION BY bank, route_id ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 9999.0)
    AS time_since_last_bank_route_success,
  CASE WHEN count(*) OVER wb > 0 THEN amount / (sum(amount) OVER wb / count(*) OVER wb) END AS amount_to_bank_avg_ratio
FROM oa WINDOW wb AS (PARTITION BY bank ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@register("orders_txn_order_features")
def q_orders_txn_order_features(c: Ctx) -> DataFrame:
    """W12/W13 on the second binding (orders x customer), where txn order differs from time order."""
    from routewise.operators.features import scope_cells, txn_order_features
    a = _orders_attempts(c)
    from routewise.operators.features import adaptive_block_size
    bs = adaptive_block_size(a)
    return txn_order_features(a, scope_cells(a, bs), bs).select(
        "txn_id", "time_since_last_bank_route_success", "amount_to_bank_avg_ratio")


ORACLE["orders_txn_order_features"] = QUERIES_SQL_ORDERS


@register("orders_route_rates")
def q_orders_route_rates(c: Ctx) -> DataFrame:
    """W2 on the second binding: 5/15-day route success rates at every active (route, day)."""
    from routewise.operators.features import build_state
    a = _orders_attempts(c)
    st = build_state(a, c.routes, 86400, None)
    return st.route.where("is_active").select("route_id", "tick", "route_success_rate_5m", "route_success_rate_15m")


ORACLE["orders_route_rates"] = ORDERS_ATTEMPTS + """
, rc AS (SELECT route_id, tick, count(*) AS n, sum(success) AS k FROM oa GROUP BY route_id, tick)
SELECT route_id, tick,
  CASE WHEN sum(n) OVER w5 > 0 THEN sum(k) OVER w5 / sum(n) OVER w5 END AS route_success_rate_5m,
  CASE WHEN sum(n) OVER w15 > 0 THEN sum(k) OVER w15 / sum(n) OVER w15 END AS route_success_rate_15m
FROM rc WINDOW w5 AS (PARTITION BY route_id ORDER BY tick RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w15 AS (PARTITION BY route_id ORDER BY tick RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING)"""


@register("validate_orders")
def q_validate_orders(c: Ctx) -> DataFrame:
    """Q1 on the second binding, whose days reach beyond the horizon and whose networks no route supports."""
    return QA.validate_attempts(_orders_attempts(c), c.routes, 9500)


ORACLE["validate_orders"] = ORDERS_ATTEMPTS + """
SELECT unnest(['unknown_route_id', 'negative_tick', 'tick_beyond_horizon', 'unsupported_network']) AS rule,
  unnest([count_if(route_id NOT IN ('R1', 'R2', 'R3', 'R4')), count_if(tick < 0), count_if(tick >= 9500), count(*)]) AS violations
FROM oa"""


@register("quarantine_orders", None)
def q_quarantine_orders(c: Ctx) -> DataFrame:
    """Q1, the rows themselves: attempts over a route that is not (here: no longer) in the dimension."""
    return QA.quarantine(_orders_attempts(c), c.routes.where(F.col("route_id") != "R4")).select("txn_id", "route_id")


ORACLE["quarantine_orders"] = ORDERS_ATTEMPTS + "SELECT txn_id, route_id FROM oa WHERE route_id = 'R4'"


@register("no_eligible_route_orders", "SELECT o_orderkey AS txn_id, 'CARD' AS payment_method, o_orderpriority AS network FROM orders")
def q_no_eligible_route_orders(c: Ctx) -> DataFrame:
    """J8 on the second binding, whose networks no route accepts."""
    return CD.no_eligible_route(_orders_attempts(c), c.eligibility).select("txn_id", "payment_method", "network")
