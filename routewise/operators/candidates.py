"""Candidate expansion: every test transaction x each eligible route.

Expansion is an equi-join of the transactions with the 28-row eligibility
dimension on (payment_method, network) -- a broadcast hash join, no
nested loop and no cross join.  Per-route features for candidate routes are
looked up in the wide state at the (bank, route, network, tick) points that
were evaluated with the feature state (``build_state(probes=True)``): clock
windows are exact (dense semantics); last-event features are as-of the
start of the tick (J11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.operators.features import FeatureState, ROUTE_LIVE, WIDE_KEYS, add_engineered, route_fee

TXN_LEVEL = ("txn_id", "tick", "day_in_week", "hour_of_day", "amount", "bank", "network", "payment_method",
             "merchant", "device", "risk", "bank_failure_rate_5m", "network_failure_rate_5m",
             "amount_to_bank_avg_ratio")


def test_transactions(features: DataFrame) -> DataFrame:
    """Route-independent columns of test transactions; actual route/outcome kept."""
    return (features.where(F.col("dataset_split") == "test")
            .select(*TXN_LEVEL, F.col("route_id").alias("actual_route_id"),
                    F.col("success").alias("actual_success")))


def test_attempts(attempts: DataFrame, train_ticks) -> DataFrame:
    """The test transactions straight from the attempts, where no feature is asked for."""
    return (attempts.where(F.col("tick") >= train_ticks)
            .select("txn_id", "tick", "amount", "bank", "network", "payment_method", "merchant", "device", "risk",
                    F.col("route_id").alias("actual_route_id"), F.col("success").alias("actual_success")))


def expand_candidates(txns: DataFrame) -> DataFrame:
    """Every transaction x all routes (generator, no join)."""
    rids = F.array(*[F.lit(r) for r in C.ROUTE_IDS])
    return txns.select("*", F.explode(rids).alias("route_id"))


def eligible_routes(txns: DataFrame, eligibility: DataFrame) -> DataFrame:
    """J6+J7: transactions x routes accepting both payment method and network."""
    return txns.join(F.broadcast(eligibility), ["payment_method", "network"], "inner")


def no_eligible_route(txns: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Transactions no route accepts."""
    return txns.join(F.broadcast(eligibility.select("payment_method", "network").distinct()),
                     ["payment_method", "network"], "left_anti")


def candidate_features(cands: DataFrame, state: FeatureState) -> DataFrame:
    """J9 (+J11): look up per-route state for each candidate, then P2-P6."""
    live = state.wide.select(*WIDE_KEYS, *ROUTE_LIVE, "route_failure_rate_1m", "bank_route_success_rate_15m",
                             F.col("asof_time_since_last_bank_route_success").alias("time_since_last_bank_route_success"))
    x = (cands.join(live, list(WIDE_KEYS), "left")
         .join(F.broadcast(state.baselines), "route_id", "left")
         .withColumn("route_cost_percent", route_fee(F.col("route_id"))))
    return add_engineered(x)


def lookup_first_in_tick(attempts_with_feature: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of the first row (txn order) per (keys, tick).

    Order-aware dedup (``dropDuplicates`` keeps an arbitrary row): one
    aggregate with ``min_by`` instead of a sort of the whole table.
    """
    return (attempts_with_feature.groupBy(*keys, "tick")
            .agg(F.min_by(value, "txn_id").alias(value)))
