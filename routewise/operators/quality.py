"""Data-quality checks as single aggregate jobs (no per-rule rescans)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_attempts(attempts: DataFrame, routes: DataFrame, horizon_ticks: int) -> DataFrame:
    """Q1: one row per rule with its violation count.

    Rules: unknown route_id, negative tick, tick >= horizon, and (T12) a
    network observed in the data that no route supports.  Route membership
    uses a broadcast of the 4-row dimension; all counts come from one scan.
    """
    known = F.broadcast(routes.select("route_id", F.lit(True).alias("_known")))
    nets = F.broadcast(routes.select(F.explode("supported_networks").alias("network")).distinct()
                       .select("network", F.lit(True).alias("_net_ok")))
    x = attempts.join(known, "route_id", "left").join(nets, "network", "left")
    agg = x.agg(F.count_if(F.col("_known").isNull()).alias("unknown_route_id"),
                F.count_if(F.col("tick") < 0).alias("negative_tick"),
                F.count_if(F.col("tick") >= horizon_ticks).alias("tick_beyond_horizon"),
                F.count_if(F.col("_net_ok").isNull()).alias("unsupported_network"))
    return agg.select(F.expr("stack(4, 'unknown_route_id', unknown_route_id, 'negative_tick', negative_tick, "
                             "'tick_beyond_horizon', tick_beyond_horizon, 'unsupported_network', unsupported_network)"
                             " AS (rule, violations)"))


def require_valid(attempts: DataFrame, routes: DataFrame, horizon_ticks: int) -> DataFrame:
    """Q1, raising form: the attempts as they are, or ValueError naming every violated rule and its count."""
    broken = {r["rule"]: r["violations"] for r in validate_attempts(attempts, routes, horizon_ticks).collect() if r["violations"]}
    if broken:
        raise ValueError("invalid attempts: " + ", ".join(f"{k}: {v}" for k, v in sorted(broken.items())))
    return attempts


def quarantine(attempts: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows whose route is not in the dimension (left anti-join, broadcast side)."""
    return attempts.join(F.broadcast(routes.select("route_id")), "route_id", "left_anti")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q2: nulls per column, one aggregate then unpivot."""
    cols = list(columns or df.columns)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "n_null")


def split_counts(df: DataFrame, col: str = "dataset_split") -> DataFrame:
    """Q3: rows per split."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
