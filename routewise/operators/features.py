"""Point-in-time features (never see the current outcome).

Plan shape for the feature table at scale:

* one scan of ``attempts`` -> :func:`scope_cells`: per scope (route, bank,
  network, bank x route, global) x tick counters plus per (bank, route,
  txn-block) partial sums -- partial aggregation map-side, one shuffle,
  result bounded by keys x ticks (+ keys x blocks);
* small window plans over those cells give every rolling feature, and one
  wide state table keyed by (bank, route, network, tick) carries them all;
* a second scan of ``attempts`` meets two tables, whatever their size: the
  block prefixes by (bank, txn-block), in the exchange that the in-block
  windows need anyway, and the wide state by its key, which no hot bank,
  route or network dominates.  That makes two exchanges of the fact table;
  the planner may turn either join into a broadcast on a measured size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.functions.exprs import (capacity_multiplier, day_in_week, flagged_down, health_label,
                                       hour_of_day, ratio)
from routewise.operators.prefix import DEFAULT_BLOCK_SIZE, block_of, block_prefix, in_block_window
from routewise.operators.timeline import (active_rows_window, clock_window, last_before,
                                          prior_rolling_sum, semi_dense_cells, timeline_bounds)
from routewise.plans.materialize import checkpointed

def _const_map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])


def route_share(route_id: Column) -> Column:
    """Traffic share of a route (router weights renormalised over all routes)."""
    total = sum(C.ROUTE_WEIGHTS.values())
    return _const_map((k, v / total) for k, v in C.ROUTE_WEIGHTS.items())[route_id]


def route_capacity(route_id: Column) -> Column:
    return _const_map((r[0], float(r[6])) for r in C.ROUTES)[route_id]


def route_fee(route_id: Column) -> Column:
    return _const_map((r[0], r[3]) for r in C.ROUTES)[route_id]

COUNTS = ("request_count", "success_count", "failure_count", "latency_sum")


# ----------------------------------------------------------------- scalars
def bounds(attempts: DataFrame, train_fraction: float = C.TRAIN_FRACTION) -> tuple[Column, Column]:
    """(total_ticks, train_ticks) as scalar sub-queries (stay lazy)."""
    b = timeline_bounds(attempts, train_fraction)
    return b.select("total_ticks").scalar(), b.select("train_ticks").scalar()


# ------------------------------------------------------------ scope cells
def scope_cells(attempts: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """One pass, six scopes + transaction blocks.

    scope in {route, bank, network, bank_route, wide, global, block}; unused
    key columns are NULL.  For scope 'block' the grouping is (bank, route_id,
    block) and ``tick`` is NULL.
    """
    nul = F.lit(None).cast("string")
    nl = F.lit(None).cast("long")
    bank, route, net, tick = F.col("bank"), F.col("route_id"), F.col("network"), F.col("tick")

    def sc(name, b, r, n, t, blk):
        return F.struct(F.lit(name).alias("scope"), b.alias("bank"), r.alias("route_id"),
                        n.alias("network"), t.alias("tick"), blk.alias("block"))

    scopes = F.array(
        sc("route", nul, route, nul, tick, nl),
        sc("bank", bank, nul, nul, tick, nl),
        sc("network", nul, nul, net, tick, nl),
        sc("bank_route", bank, route, nul, tick, nl),
        sc("wide", bank, route, net, tick, nl),
        sc("global", nul, nul, nul, tick, nl),
        sc("block", bank, route, nul, nl, block_of("txn_id", block_size)),
    )
    x = attempts.select(F.explode(scopes).alias("s"), "success", "latency_ms", "amount", "tick", "txn_id")
    return (x.groupBy("s.scope", "s.bank", "s.route_id", "s.network", "s.tick", "s.block")
            .agg(F.count(F.lit(1)).alias("request_count"),
                 F.sum("success").cast("long").alias("success_count"),
                 F.sum("latency_ms").alias("latency_sum"),
                 F.sum("amount").alias("amount_sum"),
                 F.max_by("tick", F.when(F.col("success") == 1, F.col("txn_id"))).alias("last_success_tick"))
            .withColumn("failure_count", F.col("request_count") - F.col("success_count")))


def _scope(cells: DataFrame, name: str, *keys: str) -> DataFrame:
    return cells.where(F.col("scope") == name).select(*keys, "tick", *COUNTS)


# ---------------------------------------------------------------- baselines
def training_baselines(attempts: DataFrame, train_ticks: Column, routes: DataFrame) -> DataFrame:
    """Per route mean success and latency over training ticks only.

    Restricted to routes of the 4-row dimension, so the result has a proven
    size bound and can be broadcast.
    """
    return (attempts.where(F.col("tick") < train_ticks)
            .groupBy("route_id")
            .agg(F.avg("success").alias("route_base_success_rate"),
                 F.avg("latency_ms").alias("route_base_latency_ms"))
            .join(F.broadcast(routes.select("route_id")), "route_id", "left_semi"))


def baselines_from_cells(cells: DataFrame, train_ticks: Column, routes: DataFrame) -> DataFrame:
    """G3 from the route cells (same numbers, no extra scan of the fact table)."""
    return (cells.where((F.col("scope") == "route") & (F.col("tick") < train_ticks))
            .groupBy("route_id")
            .agg((F.sum("success_count") / F.sum("request_count")).alias("route_base_success_rate"),
                 (F.sum("latency_sum") / F.sum("request_count")).alias("route_base_latency_ms"))
            .join(F.broadcast(routes.select("route_id")), "route_id", "left_semi"))


def overall_baseline(baselines: DataFrame) -> Column:
    """Unweighted mean of the route baselines (fallback prior), scalar."""
    return baselines.agg(F.avg("route_base_success_rate")).scalar()


# ------------------------------------------------------------ route state
def route_state(cells: DataFrame, tick_seconds: int, horizon: Column | None = None,
                probes: DataFrame | None = None) -> DataFrame:
    """W1-W6, W11, G5, G6 per (route_id, tick) on the semi-dense timeline.

    ``probes`` (route_id, tick) adds extra evaluation points (candidate
    routes at ticks where they had no traffic).
    """
    route = _scope(cells, "route", "route_id")
    spine = semi_dense_cells(route, ["route_id"], C.WINDOW_5, horizon, counts=COUNTS)
    if probes is not None:
        z = probes.select("route_id", "tick", *[F.lit(0).cast(route.schema[c].dataType).alias(c) for c in COUNTS])
        spine = (spine.drop("is_active").unionByName(z).groupBy("route_id", "tick")
                 .agg(*[F.sum(c).alias(c) for c in COUNTS])
                 .withColumn("is_active", F.col("request_count") > 0))
    k = ["route_id"]
    req5 = prior_rolling_sum("request_count", k, C.WINDOW_5)
    rate5 = ratio(prior_rolling_sum("success_count", k, C.WINDOW_5), req5)
    s = spine.select(
        "route_id", "tick", "is_active", *COUNTS,
        rate5.alias("route_success_rate_5m"),
        ratio(prior_rolling_sum("success_count", k, C.WINDOW_15),
              prior_rolling_sum("request_count", k, C.WINDOW_15)).alias("route_success_rate_15m"),
        ratio(prior_rolling_sum("latency_sum", k, C.WINDOW_5), req5).alias("route_avg_latency_5m"),
        prior_rolling_sum("request_count", k, C.WINDOW_LOAD).cast("double").alias("route_current_load"),
        prior_rolling_sum("request_count", k, C.WINDOW_1).cast("double").alias("route_requests_1m"),
        # The previous *active* cell, whatever its distance.
        F.last(F.when(F.col("is_active"), F.col("failure_count") / F.col("request_count")), ignorenulls=True)
        .over(Window.partitionBy("route_id").orderBy("tick").rangeBetween(Window.unboundedPreceding, -1))
        .alias("route_failure_rate_1m"),
    )
    flag = F.coalesce(F.col("route_success_rate_5m") < C.FLAG_DOWN_THRESHOLD, F.lit(False))
    s = s.select(
        "*",
        flagged_down(F.col("route_success_rate_5m")).alias("route_flagged_down"),
        F.coalesce((F.col("tick") - last_before(F.when(flag, F.col("tick")), k)).cast("double"),
                   F.lit(C.NO_EVENT_SENTINEL)).alias("time_since_last_failure"),
    )
    # system_tps: all requests of the previous tick / tick length (causal).
    glob = _scope(cells, "global").select((F.col("tick") + 1).alias("tick"),
                                          (F.col("request_count") / F.lit(float(tick_seconds))).alias("system_tps"))
    s = s.join(glob, "tick", "left").withColumn("system_tps", F.coalesce("system_tps", F.lit(0.0)))
    label = health_label(F.col("route_success_rate_5m"))
    return s.select(
        "*",
        (F.col("system_tps") * route_share(F.col("route_id"))
         / route_capacity(F.col("route_id"))).alias("route_utilization"),
        label.alias("health_label"),
        (route_capacity(F.col("route_id")) * capacity_multiplier(label)).alias("route_effective_capacity_tps"),
    )


def bank_route_state(cells: DataFrame, baselines: DataFrame, prior_default: Column,
                     probes: DataFrame | None = None) -> DataFrame:
    """W8 per (bank, route_id, tick): shrunk 15-tick success rate.

    Also the as-of form of W12 (J11): ticks since the last tick of the pair
    with a success, strictly before the current tick.  ``probes`` adds
    (bank, route_id, tick) points without traffic (candidate routes); a pair
    never seen gets its route prior (D11).
    """
    br = _scope(cells, "bank_route", "bank", "route_id")
    if probes is not None:
        z = probes.select("bank", "route_id", "tick",
                          *[F.lit(0).cast(br.schema[c].dataType).alias(c) for c in COUNTS])
        br = br.unionByName(z).groupBy("bank", "route_id", "tick").agg(*[F.sum(c).alias(c) for c in COUNTS])
    k = ["bank", "route_id"]
    s15 = prior_rolling_sum("success_count", k, C.WINDOW_15)
    a15 = prior_rolling_sum("request_count", k, C.WINDOW_15)
    last_succ = last_before(F.when(F.col("success_count") > 0, F.col("tick")), k)
    x = br.select("bank", "route_id", "tick", s15.alias("s15"), a15.alias("a15"),
                  F.coalesce((F.col("tick") - last_succ).cast("double"), F.lit(C.NO_EVENT_SENTINEL))
                  .alias("asof_time_since_last_bank_route_success"))
    x = x.join(F.broadcast(baselines.select("route_id", "route_base_success_rate")), "route_id", "left")
    prior = F.coalesce(F.col("route_base_success_rate"), prior_default)
    return x.select("bank", "route_id", "tick",
                    ((F.col("s15") + C.BANK_ROUTE_SHRINK_K * prior) / (F.col("a15") + C.BANK_ROUTE_SHRINK_K))
                    .alias("bank_route_success_rate_15m"),
                    "asof_time_since_last_bank_route_success")


def active_failure_rate(cells: DataFrame, scope: str, key: str, out: str,
                        n: int = C.ACTIVE_ROWS_5, mode: str = "active") -> DataFrame:
    """Failures / attempts over the previous n populated ticks (or clock ticks)."""
    t = _scope(cells, scope, key)
    w = active_rows_window([key], n) if mode == "active" else clock_window([key], n)
    return t.select(key, "tick", ratio(F.sum("failure_count").over(w), F.sum("request_count").over(w)).alias(out))


# ---------------------------------------------------- transaction order
def txn_order_features(attempts: DataFrame, cells: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE,
                       prefix: DataFrame | None = None) -> DataFrame:
    """W12 + W13 for every attempt, via blocked prefix scans.

    W12 time_since_last_bank_route_success: tick - tick of the last success
    of the same (bank, route) among rows with smaller txn_id; else 9999.
    W13 amount_to_bank_avg_ratio: amount / mean amount of all prior rows of
    the bank in txn_id order; NULL on the first.

    The prefixes have one row per (bank, block), the routes' last successes
    as a map (at most one entry per route), so windows and join share one
    exchange on (bank, block).
    """
    if prefix is None:
        prefix = block_prefixes(cells)
    a = attempts.withColumn("block", block_of("txn_id", block_size))
    w_br = in_block_window(["bank", "route_id"])
    w_b = in_block_window(["bank"])
    a = a.select(
        "*",
        F.last(F.when(F.col("success") == 1, F.col("tick")), ignorenulls=True).over(w_br).alias("_in_last"),
        F.sum("amount").over(w_b).alias("_in_sum"),
        F.count(F.lit(1)).over(w_b).alias("_in_cnt"),
    )
    a = a.join(prefix, ["bank", "block"], "left")
    last_succ = F.coalesce(F.col("_in_last"), F.col("prev_last_success")[F.col("route_id")])
    tot = F.coalesce(F.col("_in_sum"), F.lit(0.0)) + F.coalesce(F.col("prev_amount_sum"), F.lit(0.0))
    cnt = F.coalesce(F.col("_in_cnt"), F.lit(0)) + F.coalesce(F.col("prev_request_count"), F.lit(0))
    return a.select(
        *[c for c in attempts.columns],
        F.coalesce((F.col("tick") - last_succ).cast("double"), F.lit(C.NO_EVENT_SENTINEL))
        .alias("time_since_last_bank_route_success"),
        F.when(cnt > 0, F.col("amount") / (tot / cnt)).alias("amount_to_bank_avg_ratio"),
    )


def block_prefixes(cells: DataFrame) -> DataFrame:
    """(bank, block): amount sum and count of all earlier blocks, and each route's last success tick in them."""
    blocks = cells.where(F.col("scope") == "block")
    sums = blocks.groupBy("bank", "block").agg(
        F.sum("amount_sum").alias("amount_sum"), F.sum("request_count").alias("request_count"),
        *[F.max(F.when(F.col("route_id") == r, F.col("last_success_tick"))).alias(f"last_{r}") for r in C.ROUTE_IDS])
    lasts = [f"last_{r}" for r in C.ROUTE_IDS]
    pre = block_prefix(sums, ["bank"], sums=["amount_sum", "request_count"], lasts=lasts)
    routes = F.create_map(*[x for r in C.ROUTE_IDS for x in (F.lit(r), F.col(f"prev_last_{r}"))])
    return pre.select("bank", "block", "prev_amount_sum", "prev_request_count", routes.alias("prev_last_success"))


# ---------------------------------------------------------- feature table
@dataclass
class FeatureState:
    """State tables of one feature build; all bounded by keys x ticks (or keys x blocks)."""
    cells: DataFrame
    route: DataFrame
    bank_route: DataFrame
    bank_rate: DataFrame
    network_rate: DataFrame
    baselines: DataFrame
    prefix: DataFrame
    total_ticks: Column
    train_ticks: Column
    probes: bool = False
    block_size: int = DEFAULT_BLOCK_SIZE

    @cached_property
    def wide(self) -> DataFrame:
        """All live columns per (bank, route_id, network, tick), written once.

        With probes, every route at every (bank, network, tick) with traffic.
        """
        keys = self.cells.where(F.col("scope") == "wide")
        if self.probes:
            rids = F.array(*[F.lit(r) for r in C.ROUTE_IDS])
            seen = keys.select("bank", "network", "tick").distinct().select("bank", F.explode(rids).alias("route_id"),
                                                                            "network", "tick")
            keys = keys.select("bank", "route_id", "network", "tick").unionByName(seen).distinct()
        keys = keys.select("bank", "route_id", "network", "tick")
        wide = (keys.join(self.route.select("route_id", "tick", *ROUTE_LIVE, "route_failure_rate_1m"), ["route_id", "tick"], "left")
                .join(self.bank_route, ["bank", "route_id", "tick"], "left")
                .join(self.bank_rate, ["bank", "tick"], "left")
                .join(self.network_rate, ["network", "tick"], "left"))
        return checkpointed(wide, "wide_state")


WIDE_KEYS = ("bank", "route_id", "network", "tick")


def adaptive_block_size(attempts: DataFrame, target_blocks: int = 1 << 14, floor: int = 1 << 10) -> int:
    """Transaction-block width so that each (bank, route) has <= ``target_blocks`` blocks.

    One min/max aggregate over the id column (cheap, column-pruned).  Block
    tables are then bounded by banks x target_blocks rows, and each in-block
    window partition holds at most range / target_blocks rows.
    """
    lo, hi = attempts.agg(F.min("txn_id"), F.max("txn_id")).first()
    if lo is None:
        return floor
    return max(floor, -(-(int(hi) - int(lo) + 1) // target_blocks))


def build_state(attempts: DataFrame, routes: DataFrame, tick_seconds: int = 3600,
                block_size: int | None = DEFAULT_BLOCK_SIZE, probes: bool = False,
                rate_mode: str = "active") -> FeatureState:
    """Scan the fact table once into scope cells and derive every state table.

    The cells are written (shared folder); all state tables are functions of
    them.  The plan is the same at every size.

    ``probes=True`` also evaluates every route (and bank x route) at every
    tick with traffic, for candidate-route lookups (<= 4x the cells).
    ``block_size=None`` sizes transaction blocks from the id range so the
    block tables stay bounded (see :func:`adaptive_block_size`).

    Runs Spark jobs: the cell table is written, and the timeline length and
    at most one baseline per route are fetched.
    """
    if block_size is None:
        block_size = adaptive_block_size(attempts)
    cells = checkpointed(scope_cells(attempts, block_size), "scope_cells")
    # The timeline length comes back as a literal, so later plans carry no nested sub-queries.
    total_n = int(cells.where(F.col("scope") == "global").agg(F.max(F.col("tick") + 1)).first()[0] or 0)
    train_n = int(total_n * C.TRAIN_FRACTION)
    total, train = F.lit(total_n).cast("long"), F.lit(train_n).cast("long")
    # Route baselines: at most one row per route of the 4-row dimension, so
    # the fitted values are fetched and re-served as a tiny broadcast table.
    base_rows = baselines_from_cells(cells, train, routes).collect()
    spark = attempts.sparkSession
    baselines = F.broadcast(spark.createDataFrame(
        [tuple(r) for r in base_rows],
        "route_id string, route_base_success_rate double, route_base_latency_ms double"))
    rates = [r["route_base_success_rate"] for r in base_rows if r["route_base_success_rate"] is not None]
    prior_default = F.lit(sum(rates) / len(rates) if rates else None).cast("double")
    rprobe = brprobe = None
    if probes:
        rids = F.array(*[F.lit(r) for r in C.ROUTE_IDS])
        rprobe = (cells.where(F.col("scope") == "global")
                  .select(F.explode(rids).alias("route_id"), "tick"))
        brprobe = (cells.where(F.col("scope") == "bank")
                   .select("bank", F.explode(rids).alias("route_id"), "tick"))
    route = route_state(cells, tick_seconds, total, rprobe)
    bank_route = bank_route_state(cells, baselines, prior_default, brprobe)
    bank_rate = active_failure_rate(cells, "bank", "bank", "bank_failure_rate_5m", mode=rate_mode)
    net_rate = active_failure_rate(cells, "network", "network", "network_failure_rate_5m", mode=rate_mode)
    return FeatureState(cells, route, bank_route, bank_rate, net_rate, baselines, block_prefixes(cells), total, train,
                        probes, block_size)


ROUTE_LIVE = ("route_success_rate_5m", "route_success_rate_15m", "route_avg_latency_5m",
              "route_current_load", "route_requests_1m", "time_since_last_failure",
              "route_flagged_down", "route_utilization", "route_effective_capacity_tps", "system_tps")


def feature_table(attempts: DataFrame, state: FeatureState, tick_seconds: int = 3600,
                  block_size: int = DEFAULT_BLOCK_SIZE, engineered: bool = False) -> DataFrame:
    """The 28-column feature table (v2), optionally with the engineered inputs."""
    a = attempts
    if engineered:
        a = txn_order_features(a, state.cells, state.block_size, state.prefix)
    live = [*ROUTE_LIVE, "bank_route_success_rate_15m"]
    if engineered:
        live += ["route_failure_rate_1m", "bank_failure_rate_5m", "network_failure_rate_5m"]
    a = (a.join(state.wide.select(*WIDE_KEYS, *live), list(WIDE_KEYS), "left")
         .join(F.broadcast(state.baselines), "route_id", "left"))
    a = a.select(
        "*",
        day_in_week(F.col("tick"), tick_seconds).alias("day_in_week"),
        hour_of_day(F.col("tick"), tick_seconds).alias("hour_of_day"),
        route_fee(F.col("route_id")).alias("route_cost_percent"),
        F.when(F.col("tick") < state.train_ticks, "train").otherwise("test").alias("dataset_split"),
    )
    cols = list(C.FEATURE_TABLE_COLUMNS)
    if engineered:
        return add_engineered(a).select(*cols, *ENGINEERED)
    return a.select(*cols)


ENGINEERED = ("route_failure_rate_5m", "route_failure_rate_15m", "route_success_drop_5m",
              "route_success_drop_15m", "route_latency_ratio", "bank_route_gap", "route_stress",
              "bank_failure_rate_5m", "network_failure_rate_5m", "route_failure_rate_1m",
              "time_since_last_bank_route_success", "amount_to_bank_avg_ratio")


def add_engineered(df: DataFrame) -> DataFrame:
    """Arithmetic on the live route columns (NULL propagates)."""
    c = F.col
    return df.select(
        "*",
        (1.0 - c("route_success_rate_5m")).alias("route_failure_rate_5m"),
        (1.0 - c("route_success_rate_15m")).alias("route_failure_rate_15m"),
        (c("route_base_success_rate") - c("route_success_rate_5m")).alias("route_success_drop_5m"),
        (c("route_base_success_rate") - c("route_success_rate_15m")).alias("route_success_drop_15m"),
        (c("route_avg_latency_5m") / (c("route_base_latency_ms") + C.LATENCY_EPS)).alias("route_latency_ratio"),
        (c("bank_route_success_rate_15m") - c("route_success_rate_15m")).alias("bank_route_gap"),
        (c("route_utilization") * (1.0 - c("route_success_rate_15m"))).alias("route_stress"),
    )
