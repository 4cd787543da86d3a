"""Timeline primitives over an integer ``tick`` column.

Three notions of "the last w ticks" coexist and are kept apart:

* clock window ``[m-w, m)`` -> ``rangeBetween(-w, -1)`` on the tick value;
* active-row window (previous w populated ticks) -> ``rowsBetween(-w, -1)``;
* strictly prior rows in transaction order -> blocked prefix scans
  (:mod:`routewise.operators.prefix`).

All windows run on pre-aggregated cell tables (keys x tick), whose size is
bounded by keys x ticks regardless of the fact-table volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICK = "tick"


def minute_table(df: DataFrame, keys: Sequence[str], tick: str = TICK) -> DataFrame:
    """Per (keys, tick) request, success, failure counts and latency sum.

    A plain ``groupBy`` so Spark runs partial (map-side) aggregation before
    the shuffle: the shuffle carries one row per cell per map task.
    """
    return (df.groupBy(*keys, tick)
            .agg(F.count(F.lit(1)).alias("request_count"),
                 F.sum("success").cast("long").alias("success_count"),
                 F.sum("latency_ms").alias("latency_sum"))
            .withColumn("failure_count", F.col("request_count") - F.col("success_count")))


def clock_window(keys: Sequence[str], w: int, tick: str = TICK) -> Window:
    """Frame covering ticks [m-w, m-1] (current tick excluded)."""
    return Window.partitionBy(*keys).orderBy(tick).rangeBetween(-w, -1)


def active_rows_window(keys: Sequence[str], n: int, tick: str = TICK) -> Window:
    """Frame covering the previous n populated rows."""
    return Window.partitionBy(*keys).orderBy(tick).rowsBetween(-n, -1)


def prior_rolling_sum(col: str | Column, keys: Sequence[str], w: int, tick: str = TICK) -> Column:
    """Sum over the clock window [m-w, m); 0 when the window is empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(c).over(clock_window(keys, w, tick)), F.lit(0))


def prior_sum(col: str | Column, keys: Sequence[str], w: int, tick: str = TICK) -> Column:
    """Clock-window sum that stays NULL when the window is empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).over(clock_window(keys, w, tick))


def prior_rows_sum(col: str | Column, keys: Sequence[str], n: int, tick: str = TICK) -> Column:
    """Active-row sum over the previous n populated rows; NULL on the first."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).over(active_rows_window(keys, n, tick))


def last_before(value: Column, keys: Sequence[str], tick: str = TICK) -> Column:
    """Latest non-null ``value`` at a tick strictly before the current one."""
    w = Window.partitionBy(*keys).orderBy(tick).rangeBetween(Window.unboundedPreceding, -1)
    return F.max(value).over(w)


def semi_dense_cells(cells: DataFrame, keys: Sequence[str], reach: int,
                     horizon: Column | None = None, tick: str = TICK,
                     counts: Sequence[str] = ("request_count", "success_count", "latency_sum",
                                              "failure_count")) -> DataFrame:
    """Fill the timeline with zero cells where a clock window can still see data.

    Every active cell at tick t is followed by ghost cells t+1..t+reach; a
    w-tick clock window (w <= reach) is empty after that, so features there
    are NULL/0 and flags cannot be raised.  The dense (keys x all ticks) spine
    gives identical results on every populated cell and on every tick where
    a flag can change.  One shuffle: union + groupBy.
    """
    ghosts = (cells.select(*keys, F.explode(F.sequence(F.col(tick) + 1, F.col(tick) + reach)).alias(tick))
              .select(*keys, tick, *[F.lit(0).cast(cells.schema[c].dataType).alias(c) for c in counts]))
    both = cells.select(*keys, tick, *counts).unionByName(ghosts)
    if horizon is not None:
        both = both.where(F.col(tick) < horizon)
    return (both.groupBy(*keys, tick)
            .agg(*[F.sum(c).alias(c) for c in counts])
            .withColumn("is_active", F.col("request_count") > 0))


def timeline_bounds(attempts: DataFrame, train_fraction: float, tick: str = TICK) -> DataFrame:
    """One row: total_ticks = max(tick)+1, train_ticks = int(total * fraction)."""
    total = F.max(tick) + 1
    return attempts.agg(total.cast("long").alias("total_ticks"),
                        (total * F.lit(train_fraction)).cast("long").alias("train_ticks"))
