"""Bind driver tables to the attempts fact table.

`attempts` has one row per transaction sent to one route:
txn_id, ts, tick, amount, bank, network, payment_method, merchant, device,
risk, route_id, success, latency_ms.  ``tick`` is an integer time index of
``tick_seconds`` seconds since 2024-01-01 00:00 UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routewise import constants as C
from routewise.sources.tables import read_table

EPOCH_2024 = 1704067200

# ---------------------------------------------------------------- fixed values
# Dimension values the events binding draws from, in this order.
BANKS = ("HDFC", "ICICI", "SBI", "Axis", "Kotak", "BOB")
MERCHANTS = ("Food", "Shopping", "Travel", "Electronics", "Fuel", "Healthcare")
DEVICES = ("Android", "iOS", "Web")
# --------------------------------------------------------------- end fixed values

ATTEMPT_COLUMNS = ("txn_id", "tick", "amount", "bank", "network", "payment_method",
                   "merchant", "device", "risk", "route_id", "success", "latency_ms")


def utc_instant(df: DataFrame, col: str) -> Column:
    """Timestamp column as a UTC instant, independent of the session time zone.

    The driver tables store wall-clock TIMESTAMP_NTZ values meaning UTC; a
    plain cast to TIMESTAMP would read them in the session time zone.
    """
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(col))
        return F.timestamp_micros(micros)
    return F.col(col).cast("timestamp")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def risk_band(amount: Column) -> Column:
    lo, hi = C.RISK_BAND_EDGES
    return (F.when(amount < lo, "LOW").when(amount < hi, "MEDIUM").otherwise("HIGH"))


def weighted_route(network: Column, u: Column) -> Column:
    """Deterministic weighted route choice among the eligible routes.

    ``u`` is uniform on [0, 1000).  The weights .35/.25/.25/.15 are
    renormalised over the routes eligible for the network.
    """
    return (
        F.when(network == "Mastercard",
               F.when(u * 75 < 35000, "R1").when(u * 75 < 60000, "R3").otherwise("R4"))
        .when(network == "Rupay",
              F.when(u * 65 < 25000, "R2").when(u * 65 < 50000, "R3").otherwise("R4"))
        .otherwise(F.when(u < 350, "R1").when(u < 600, "R2").when(u < 850, "R3").otherwise("R4"))
    )


def attempts_from_events(events: DataFrame, tick_seconds: int = 3600) -> DataFrame:
    """Primary binding: the `events` table becomes payment attempts."""
    eid = F.col("event_id")
    uid = F.col("user_id")
    ts = utc_instant(events, "ts")
    e = events.select(
        eid.alias("txn_id"),
        ts.alias("ts"),
        F.floor((F.unix_micros(ts) / F.lit(1_000_000) - F.lit(EPOCH_2024)) / F.lit(tick_seconds)).cast("long").alias("tick"),
        F.greatest(F.lit(C.AMOUNT_MIN), F.least(F.round(F.col("value") * 20, 2), F.lit(C.AMOUNT_MAX))).alias("amount"),
        _pick(BANKS, uid % 6).alias("bank"),
        F.when(eid % 2 == 0, "CARD").otherwise("UPI").alias("payment_method"),
        F.when(eid % 2 == 1, "UPI")
        .when(F.expr("(event_id div 2) % 3") == 0, "Visa")
        .when(F.expr("(event_id div 2) % 3") == 1, "Mastercard")
        .otherwise("Rupay").alias("network"),
        _pick(MERCHANTS, F.expr("(user_id div 6) % 6")).alias("merchant"),
        _pick(DEVICES, uid % 3).alias("device"),
        (F.col("event_type") != "error").cast("int").alias("success"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("latency_ms"),
        ((eid * 7919) % 1000).alias("_u"),
    )
    return e.select(
        "txn_id", "ts", "tick", "amount", "bank", "network", "payment_method", "merchant", "device",
        risk_band(F.col("amount")).alias("risk"),
        weighted_route(F.col("network"), F.col("_u")).alias("route_id"),
        "success", "latency_ms",
    )


def attempts_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Second binding (txn order differs from time order): orders x customer.

    tick = day of the order date; bank = market segment; network = order
    priority; route = R(1 + custkey % 4); success = status <> 'F'.
    """
    o = orders.join(customer.select("c_custkey", "c_mktsegment"),
                    orders.o_custkey == customer.c_custkey, "left")
    ts = utc_instant(orders, "o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("txn_id"),
        ts.alias("ts"),
        F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("long").alias("tick"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_mktsegment").alias("bank"),
        F.col("o_orderpriority").alias("network"),
        F.lit("CARD").alias("payment_method"),
        F.lit("Other").alias("merchant"),
        F.lit("Web").alias("device"),
        risk_band(F.col("o_totalprice")).alias("risk"),
        F.concat(F.lit("R"), (F.col("o_custkey") % 4 + 1).cast("string")).alias("route_id"),
        (F.col("o_orderstatus") != "F").cast("int").alias("success"),
        F.lit(1.0).alias("latency_ms"),
    )


def read_attempts(spark: SparkSession, sf_dir: str, tick_seconds: int = 3600,
                  with_ts: bool = False) -> DataFrame:
    """SRC1: the attempts fact table from the driver's `events` table."""
    df = attempts_from_events(read_table(spark, sf_dir, "events"), tick_seconds)
    cols = (("ts",) if with_ts else ()) + ATTEMPT_COLUMNS
    return df.select(*cols)


ATTEMPTS_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()), T.StructField("tick", T.LongType()), T.StructField("amount", T.DoubleType()),
    *[T.StructField(c, T.StringType()) for c in ("bank", "network", "payment_method", "merchant", "device", "risk", "route_id")],
    T.StructField("success", T.IntegerType()), T.StructField("latency_ms", T.DoubleType()),
])


def read_attempts_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC1 from a file of attempts: its columns and types are checked against ATTEMPTS_SCHEMA, further columns ignored."""
    df = spark.read.parquet(path)
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'} instead of {f.dataType.simpleString()}"
             for f in ATTEMPTS_SCHEMA if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{path} holds no attempts: " + "; ".join(wrong))
    return df.select(*ATTEMPTS_SCHEMA.names)
