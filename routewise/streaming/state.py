"""Feature state that the streams keep themselves (ST2, ST11, features 22 to 24).

Requests and outcomes come as one stream in the order of their arrival.  Every micro-batch takes up the
table of the micro-batch before it and writes its own in a folder named by its id; a micro-batch that runs
again reads the same table and replaces its own.

A bucket is (scope, key, tick of the attempt); it holds one cell per tick of arrival, so a late outcome is
credited to its attempt and still seen only by requests that come after it: a request of tick m sees the
cells that arrived in ticks before m.  That makes a result independent of where micro-batches end.  A
bucket expires ``ttl_ticks`` after its last arrival.  Beside the buckets a key keeps

* its last active buckets, however old (bank, network and route rates go by populated ticks, not by the clock),
* the last successful tick of expired buckets (bank x route),
* the ticks at which it was flagged, evaluated once per tick (route),
* its amounts, those of ticks long past in one row (bank).

One shuffle per micro-batch brings a key's rows together: what it kept, the new cells, and the ticks that
requests ask for.  These are counts per tick, never requests or outcomes, so a group has a few rows per
tick of the micro-batch and of the time a bucket lives, whatever the traffic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.sources.sinks import drop_folder

#: Ticks after its last arrival at which a bucket expires.
BUCKET_TTL_TICKS = 30
KEY = ["scope", "k1", "k2"]
#: Counts of a cell, and of an answer: sums of the 5- and 15-tick windows, rate over active buckets, last event, mean amount.
COUNTS, ANSWERS = ("n", "k", "latency", "amount"), ("n5", "k5", "latency5", "n15", "k15", "active_rate", "last", "mean")
STATE = ("part string, scope string, k1 string, k2 string, tick long, arrived long, " + ", ".join(f"{c} double" for c in (*COUNTS, *ANSWERS)))
#: Scopes whose failure rates go by populated buckets, with the number of them that counts.
ACTIVE = {"bank": C.ACTIVE_ROWS_5, "network": C.ACTIVE_ROWS_5, "route": 1}
#: Tick of the row that holds all amounts of ticks long past.
LONG_AGO = -1


def late_ticks(ttl_seconds: int, tick_seconds: int) -> int:
    """Ticks by which an outcome may arrive after its attempt's."""
    return -(-ttl_seconds // tick_seconds) + 1


def new_cells(batch: DataFrame) -> DataFrame:
    """Cells of a micro-batch: outcomes in four scopes, requests in the global one, amounts per bank."""
    b, r, n, none = F.col("bank"), F.col("route_id"), F.col("network"), F.lit(None).cast("string")

    def at(part: str, scope: str, k1: Column, k2: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(scope).alias("scope"), k1.alias("k1"), k2.alias("k2"))

    outcome = F.array(at("cell", "route", r, none), at("cell", "bank", b, none), at("cell", "network", n, none), at("cell", "bank_route", b, r))
    request = F.array(at("cell", "global", none, none), at("amount", "bank", b, none))
    x = batch.select(F.explode(F.when(F.col("kind") == "outcome", outcome).otherwise(request)).alias("s"), "tick", "arrived",
                     "success", "latency_ms", "amount")
    return x.groupBy("s.part", "s.scope", "s.k1", "s.k2", "tick", "arrived").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("success").cast("double").alias("k"),
        F.sum("latency_ms").alias("latency"), F.sum("amount").alias("amount"))


def probes(batch: DataFrame, routes: list[str]) -> DataFrame:
    """The (scope, key, tick) that the requests of a micro-batch ask for, each once."""
    b, n, t, none = F.col("bank"), F.col("network"), F.col("tick"), F.lit(None).cast("string")
    at = lambda scope, k1, k2: F.struct(F.lit(scope).alias("scope"), k1.alias("k1"), k2.alias("k2"))
    asked = [at("bank", b, none), at("network", n, none), at("global", none, none)]
    asked += [x for r in routes for x in (at("route", F.lit(r), none), at("bank_route", b, F.lit(r)))]
    requests = batch.where("kind = 'request'").select("bank", "network", "tick").distinct()
    return requests.select(F.explode(F.array(*asked)).alias("s"), t).select(F.lit("probe").alias("part"), "s.*", "tick").distinct()


# ------------------------------------------------------------ the rows of one key
class Cells:
    """A key's cells as matrices (bucket x ticks of delay); ``late`` is the longest delay."""

    def __init__(self, rows: pd.DataFrame, late: int):
        self.ticks, at = np.unique(rows["tick"].to_numpy(np.int64), return_inverse=True)
        delay = np.clip(rows["arrived"].to_numpy(np.int64) - rows["tick"].to_numpy(np.int64), 0, None)
        width = max(late, int(delay.max(initial=0))) + 1
        self.value = {}
        for c in ("n", "k", "latency"):
            m = self.value[c] = np.zeros((len(self.ticks), width))
            np.add.at(m, (at, delay), rows[c].fillna(0).to_numpy(float))
        arrived = self.value["n"] > 0
        self.last = self.ticks + np.where(arrived, np.arange(width), 0).max(axis=1) if len(self.ticks) else self.ticks

    def window(self, m: np.ndarray, width: int, name: str) -> np.ndarray:
        """Sums over the attempts of [m - width, m) that had arrived before m."""
        out = np.zeros(len(m))
        for delay in range(self.value[name].shape[1]):
            total = np.concatenate([[0.0], np.cumsum(self.value[name][:, delay])])
            low, high = np.searchsorted(self.ticks, m - width), np.searchsorted(self.ticks, m - delay)
            out += np.where(high > low, total[high] - total[low], 0.0)
        return out

    def active(self, m: np.ndarray, need: int, late: int) -> np.ndarray:
        """Failure rate over the last ``need`` buckets before m of which an outcome had arrived; only the last ``late`` can be unseen."""
        seen = {c: np.cumsum(v, axis=1) for c, v in self.value.items()}
        end, most = np.searchsorted(self.ticks, m), self.value["n"].shape[1] - 1
        taken, n, k = np.zeros(len(m)), np.zeros(len(m)), np.zeros(len(m))
        for back in range(1, need + late + 1):
            i = np.maximum(end - back, 0)
            if not len(self.ticks):
                break
            delay = np.clip(m - 1 - self.ticks[i], 0, most)
            counts = (end >= back) & (taken < need) & (seen["n"][i, delay] > 0)
            n += np.where(counts, seen["n"][i, delay], 0)
            k += np.where(counts, seen["k"][i, delay], 0)
            taken += counts
        return np.where(n > 0, (n - k) / np.where(n > 0, n, 1), np.nan)

    def last_success(self, m: np.ndarray, older: float) -> np.ndarray:
        """The latest successful tick known before m."""
        i, delay = np.nonzero(self.value["k"] > 0)
        known = self.ticks[i] + delay + 1
        order = np.argsort(known, kind="stable")
        best = np.concatenate([[older], np.fmax.accumulate(np.fmax(self.ticks[i][order].astype(float), older))])
        return best[np.searchsorted(known[order], m, side="right")]


def _before(ticks: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The greatest of some sorted ticks strictly before m, or nan."""
    at = np.searchsorted(ticks, m)
    return np.where(at > 0, ticks[np.maximum(at - 1, 0)] if len(ticks) else np.nan, np.nan)


def advance_key(scope: str, rows: pd.DataFrame, high: int, evaluated: int | None, late: int, ttl_ticks: int) -> list[pd.DataFrame]:
    """Answers to a key's probes, the buckets that expire, and the rows that it keeps."""
    part = {p: g for p, g in rows.groupby("part")}
    nothing = rows.iloc[:0]
    live, recent = part.get("cell", nothing), part.get("recent", nothing)
    m = np.unique(part.get("probe", nothing)["tick"].to_numpy(np.int64))
    cells, every, past = Cells(live, late), Cells(pd.concat([live, recent]), late), high - ttl_ticks
    answer, out = {"tick": m}, []
    if scope == "global":
        answer["n5"] = cells.window(m, 1, "n")
    elif len(m):
        for w, names in ((5, ("n", "k", "latency")), (15, ("n", "k"))):
            answer |= {f"{c}{w}": cells.window(m, {5: C.WINDOW_5, 15: C.WINDOW_15}[w], c) for c in names}
    if scope in ACTIVE:
        answer["active_rate"] = every.active(m, ACTIVE[scope], late)
    if scope == "bank_route":
        older = part["success"]["tick"].max() if "success" in part else np.nan
        answer["last"] = cells.last_success(m, older)
        gone = cells.ticks[(cells.last <= past) & (cells.value["k"].sum(axis=1) > 0)]
        older = np.fmax(older, gone.max() if len(gone) else np.nan)
        if not np.isnan(older):
            out.append(pd.DataFrame({"part": ["success"], "tick": [int(older)]}))
    if scope == "route":
        asked = np.unique((cells.ticks[:, None] + np.arange(1, C.WINDOW_5 + 1)).ravel())
        asked = asked[(asked <= high) & (asked > (evaluated if evaluated is not None else -(1 << 62)))]
        n = cells.window(asked, C.WINDOW_5, "n")
        down = asked[(n > 0) & (cells.window(asked, C.WINDOW_5, "k") < C.FLAG_DOWN_THRESHOLD * n)]
        flags = np.unique(np.concatenate([part.get("flag", nothing)["tick"].to_numpy(np.int64), down]))
        answer["last"] = _before(flags, m)
        keep = flags[max(0, np.searchsorted(flags, past) - 1):]
        out.append(pd.DataFrame({"part": "flag", "tick": keep}))
    if scope == "bank":
        a = part.get("amount", nothing).groupby("tick")[["n", "amount"]].sum()
        ticks, n, s = a.index.to_numpy(np.int64), np.cumsum(a["n"].to_numpy()), np.cumsum(a["amount"].to_numpy())
        at = np.searchsorted(ticks, m) - 1
        if len(ticks):
            answer["mean"] = np.where(at >= 0, s[np.maximum(at, 0)] / n[np.maximum(at, 0)], np.nan)
        a = a.groupby(np.where(ticks < past, LONG_AGO, ticks)).sum()
        out.append(pd.DataFrame({"part": "amount", "tick": a.index.to_numpy(np.int64), "n": a["n"].to_numpy(), "amount": a["amount"].to_numpy()}))
    out.append(pd.DataFrame({"part": "answer"} | answer))
    gone = cells.ticks[cells.last <= past]
    out.append(pd.DataFrame({"part": "evicted", "tick": gone}))
    kept = pd.concat([live[~live["tick"].isin(gone)].assign(part="cell"), pd.concat([live, recent])[lambda x: x["tick"].isin(
        np.setdiff1d(every.ticks[-max(ACTIVE.values()) - late:], np.setdiff1d(cells.ticks, gone)))].assign(part="recent") if scope in ACTIVE else nothing])
    # micro-batches may be shorter than a tick: one row per cell
    out.append(kept.groupby(["part", "tick", "arrived"], as_index=False)[["n", "k", "latency"]].sum(min_count=1))
    return out


def advanced(before: DataFrame | None, evaluated: int | None, batch: DataFrame, routes: list[str], high: int, late: int,
             ttl_ticks: int = BUCKET_TTL_TICKS) -> DataFrame:
    """The table after a micro-batch of events, with the answers to its requests' probes and the buckets that expire.

    ``evaluated`` is the last tick whose flags the table before it holds, ``high`` the last tick of arrival.
    """
    kinds = dict(c.split(" ") for c in STATE.split(", "))
    rows = new_cells(batch).unionByName(probes(batch, routes), allowMissingColumns=True)
    columns = ["part", *KEY, "tick", "arrived", *COUNTS]
    if before is not None:
        rows = rows.unionByName(before.where("part in ('cell', 'recent', 'amount', 'flag', 'success')").select(*columns))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = {c: group[c].iloc[0] for c in KEY}
        found = [x for x in advance_key(key["scope"], group, high, evaluated, late, ttl_ticks) if len(x)]
        out = pd.concat(found, ignore_index=True) if found else pd.DataFrame({"part": []})
        out = out.assign(**key).reindex(columns=list(kinds))
        whole = [c for c, k in kinds.items() if k == "long"]
        return out.astype({c: "Int64" for c in whole} | {c: "float64" for c, k in kinds.items() if k == "double"})

    spark = batch.sparkSession
    clock = spark.range(1, numPartitions=1).select(F.lit("clock").alias("part"), F.lit(high).cast("long").alias("tick"))
    # few rows, but work for every core: small partitions are not put together again
    out = rows.repartition(spark.sparkContext.defaultParallelism, *KEY).groupBy(*KEY).applyInPandas(run, STATE)
    # pandas has no number for a missing double but nan
    out = out.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if kinds[c] == "double" else F.col(c) for c in kinds])
    return out.unionByName(clock, allowMissingColumns=True)


def read_state(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The table after a micro-batch; before the first one it is empty."""
    if batch_id < 0:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{root}/state/{batch_id}")


def drop_state(spark: SparkSession, root: str, batch_id: int) -> None:
    """Delete a table that no micro-batch can take up any more."""
    if batch_id >= 0:
        drop_folder(spark, f"{root}/state/{batch_id}")
