"""Scalar column expressions used by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``
so it stays inside whole-stage codegen.  Missing values are NULL, never NaN
(Spark orders NaN above every number and ``sum`` propagates it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routewise import constants as C

__all__ = [
    "ratio", "minute_index", "day_in_week", "hour_of_day", "flagged_down",
    "amount_band", "predicted_failure", "health_label", "capacity_multiplier",
]


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when den is 0 or NULL (no ±inf, no ANSI error)."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.when(den != 0, num.cast("double") / den)


def minute_index(tick: Column, tick_seconds: int) -> Column:
    return tick * F.lit(tick_seconds // 60)


def day_in_week(tick: Column, tick_seconds: int = 60) -> Column:
    """(minute // 1440) % 7 on the integer timeline (anchor = tick 0)."""
    m = minute_index(tick, tick_seconds)
    return F.floor(m / C.TICKS_PER_DAY_AT_MINUTE).cast("long") % 7


def hour_of_day(tick: Column, tick_seconds: int = 60) -> Column:
    """(minute % 1440) // 60."""
    m = minute_index(tick, tick_seconds)
    return F.floor((m % C.TICKS_PER_DAY_AT_MINUTE) / C.MINUTES_PER_HOUR).cast("long")


def flagged_down(rate_5: Column) -> Column:
    """1.0 when the trailing rate is known and below the threshold."""
    return F.coalesce(rate_5 < C.FLAG_DOWN_THRESHOLD, F.lit(False)).cast("double")


def amount_band(a: Column) -> Column:
    """How many of 100, 1,000 and 10,000 an amount reaches."""
    return sum((F.when(a >= edge, 1).otherwise(0) for edge in (100.0, 1000.0, 10000.0)), F.lit(0))


def predicted_failure(p: Column, threshold: Column | float) -> Column:
    """Failure predicted when 1 - p >= threshold (this exact form)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return ((F.lit(1.0) - p) >= t).cast("int")


def health_label(rate_5: Column) -> Column:
    """Observed health label from the trailing 5-tick success rate."""
    return (F.when(rate_5 == 0, "OUTAGE")
            .when(rate_5 < C.FLAG_DOWN_THRESHOLD, "DEGRADED")
            .otherwise("HEALTHY"))


def capacity_multiplier(label: Column) -> Column:
    m = C.HEALTH_CAPACITY_MULTIPLIER
    return (F.when(label == "OUTAGE", m["OUTAGE"])
            .when(label == "DEGRADED", m["DEGRADED"])
            .otherwise(m["HEALTHY"]))
