"""The static route dimension (4 rows) and its eligibility expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from routewise import constants as C

ROUTE_SCHEMA = T.StructType([
    T.StructField("route_id", T.StringType(), False),
    T.StructField("base_success_rate", T.DoubleType(), False),
    T.StructField("base_latency_ms", T.IntegerType(), False),
    T.StructField("route_cost_percent", T.DoubleType(), False),
    T.StructField("supported_payment_methods", T.ArrayType(T.StringType(), False), False),
    T.StructField("supported_networks", T.ArrayType(T.StringType(), False), False),
    T.StructField("base_capacity_tps", T.LongType(), False),
    T.StructField("route_weight", T.DoubleType(), False),
])


def route_dim(spark: SparkSession) -> DataFrame:
    """Route dimension; a fixed 4-row table, safe to broadcast anywhere."""
    rows = [(rid, sr, lat, fee, list(pms), list(nets), cap, C.ROUTE_WEIGHTS[rid])
            for rid, sr, lat, fee, pms, nets, cap in C.ROUTES]
    return spark.createDataFrame(rows, ROUTE_SCHEMA)


def eligibility_dim(spark: SparkSession) -> DataFrame:
    """(payment_method, network, route_id) triples a route accepts.

    Exploding the list columns once turns eligibility (list membership,
    exact string match) into an equi-join key, so candidate expansion is a
    broadcast hash join instead of a nested loop.  Size is bounded by
    routes x methods x networks (28 rows).
    """
    rows = [(pm, net, rid, idx)
            for idx, (rid, _s, _l, _f, pms, nets, _c) in enumerate(C.ROUTES)
            for pm in pms for net in nets]
    return spark.createDataFrame(
        rows, "payment_method string, network string, route_id string, route_order int")
