"""Routing policies over candidate rows and their offline evaluation.

* argmax (W14): best score per transaction, total order (p desc, raw p
  desc, route_id) -- one hash aggregate with ``max_by``; candidates of a
  transaction come from one input row, so the partial aggregate collapses
  them map-side and the shuffle carries one row per transaction.
* round robin (W15): a sequential rotation whose state is a counter mod 4.
  Each transaction is a map {0..3} -> {0..3}; maps compose, so the scan is
  (1) per block of consecutive txn_ids, compose the maps (numpy doubling);
  (2) per group of consecutive blocks, compose the block maps, and over the
  few groups the group maps -- all in Spark, nothing on the driver;
  (3) each block replays with its known start state.
* all policies of a report come from one aggregate per transaction, which
  carries each choice's outcome, so candidates are never joined to choices.
* weighted split (M16): deterministic weighted choice among eligible routes;
  the cumulative weights live in the 28-row eligibility table, so the choice
  is a filter after the broadcast join -- no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.plans.materialize import checkpointed

N_ROUTES = len(C.ROUTE_IDS)


# --------------------------------------------------------------- argmax
def argmax_route(score: str = "p", tiebreak: str | None = None) -> Column:
    """W14 as an aggregate: struct (route_id, score) of a group's best candidate."""
    order = [F.col(score)]
    if tiebreak:
        order.append(F.col(tiebreak))
    # route_order ascending wins ties -> negate it inside the max key
    key = F.struct(*order, (-F.col("route_order")).alias("neg_order"))
    return F.max_by(F.struct("route_id", F.col(score).alias("score")), key)


def policy_argmax(cands: DataFrame, score: str = "p", tiebreak: str | None = None) -> DataFrame:
    """(txn_id, route_id, score) of the best candidate."""
    return (cands.groupBy("txn_id")
            .agg(argmax_route(score, tiebreak).alias("best"))
            .select("txn_id", "best.route_id", F.col("best.score").alias(score)))


# ----------------------------------------------------------- round robin
def eligibility_mask(cands: DataFrame) -> DataFrame:
    """Per transaction the bitmask of eligible routes (bit i = route i)."""
    return (cands.groupBy("txn_id")
            .agg(F.sum(F.expr("shiftleft(1, route_order)")).cast("int").alias("mask")))


def _choice_table() -> np.ndarray:
    """choice[mask, state] = first eligible route index at or after ``state`` cyclically, -1 if none."""
    tab = np.full((1 << N_ROUTES, N_ROUTES), -1, dtype=np.int64)
    for mask in range(1 << N_ROUTES):
        for s in range(N_ROUTES):
            for k in range(N_ROUTES):
                r = (s + k) % N_ROUTES
                if mask >> r & 1:
                    tab[mask, s] = r
                    break
    return tab


def _next_state(choice: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rotation after a transaction: one step per try, so chosen index + 1 (unchanged if none)."""
    return np.where(choice >= 0, (choice + 1) % N_ROUTES, state)


def _scan(masks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of per-transaction rotation maps.

    Row i of the result maps a start state to the state after transactions
    0..i.  Hillis-Steele doubling: O(n log n) vectorised numpy, no per-row
    Python loop.
    """
    states = np.arange(N_ROUTES)
    q = _next_state(table[masks], states[None, :])            # (n, 4) per-txn maps
    d = 1
    while d < len(q):
        nq = q.copy()
        nq[d:] = np.take_along_axis(q[d:], q[:-d], axis=1)    # q[i-d] then q[i]
        q, d = nq, d * 2
    return q


def _choices(masks: np.ndarray, table: np.ndarray, s0: int) -> tuple[np.ndarray, int]:
    """Chosen route index per transaction from start state ``s0``, and the end state."""
    if len(masks) == 0:
        return np.empty(0, dtype=np.int64), s0
    q = _scan(masks, table)
    before = np.concatenate(([s0], q[:-1, s0]))
    return table[masks, before], int(q[-1, s0])


BLOCK_SIZE, GROUP_BLOCKS = 1 << 16, 1 << 12
_MAP = ", ".join(f"f{i} int" for i in range(N_ROUTES))
_F = [f"f{i}" for i in range(N_ROUTES)]


def _compose_rows(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of maps, one per row."""
    q, d = maps.copy(), 1
    while d < len(q):
        nq = q.copy()
        nq[d:] = np.take_along_axis(q[d:], q[:-d], axis=1)
        q, d = nq, d * 2
    return q


def block_starts(masks: DataFrame, block_size: int, group_blocks: int) -> DataFrame:
    """(block, start): the rotation's state before each block of transactions.

    Level 1 composes a block's transactions, level 2 the blocks of a group, level 3 the groups, of
    which there is one per ``block_size * group_blocks`` ids (2^28 by default).
    """
    table = _choice_table()

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        q = _scan(pdf.sort_values("txn_id", kind="stable")["mask"].to_numpy(), table)
        return pd.DataFrame([[int(pdf["block"].iloc[0]), *map(int, q[-1])]], columns=["block", *_F])

    def before_each(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        q = _compose_rows(pdf[_F].to_numpy(np.int64))
        out = pd.DataFrame(np.concatenate([np.arange(N_ROUTES)[None, :], q[:-1]]), columns=[f"b{i}" for i in range(N_ROUTES)])
        out.insert(0, key, pdf[key].to_numpy())
        return out

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        q = _compose_rows(pdf.sort_values("block", kind="stable")[_F].to_numpy(np.int64))
        return pd.DataFrame([[int(pdf["grp"].iloc[0]), *map(int, q[-1])]], columns=["grp", *_F])

    blocks = checkpointed(masks.select("txn_id", "mask", "block").groupBy("block")
                          .applyInPandas(of_block, f"block long, {_MAP}")
                          .withColumn("grp", F.expr(f"block div {int(group_blocks)}")), "rr_blocks")
    before = ", ".join(f"b{i} int" for i in range(N_ROUTES))
    in_group = blocks.groupBy("grp").applyInPandas(lambda p: before_each(p, "block").assign(grp=p["grp"].iloc[0]),
                                                   f"block long, {before}, grp long")
    groups = (blocks.groupBy("grp").applyInPandas(of_group, f"grp long, {_MAP}")
              .withColumn("one", F.lit(True)).groupBy("one")
              .applyInPandas(lambda p: before_each(p, "grp").rename(columns={"b0": "state"})[["grp", "state"]],
                             "grp long, state int"))
    at = F.array(*[F.col(f"b{i}") for i in range(N_ROUTES)])
    return in_group.join(groups, "grp").select("block", at[F.col("state")].alias("start"))


def round_robin(masks: DataFrame, block_size: int = BLOCK_SIZE, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Adds ``rr_order``, the route's index or -1, to rows with txn_id and mask; other columns are carried along."""
    table = _choice_table()
    rows = masks.withColumn("block", F.expr(f"txn_id div {int(block_size)}"))
    rows = rows.join(block_starts(rows, block_size, group_blocks), "block")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("txn_id", kind="stable")
        out, _ = _choices(pdf["mask"].to_numpy(), table, int(pdf["start"].iloc[0]))
        return pdf.drop(columns=["block", "start"]).assign(rr_order=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in masks.schema)
    return rows.groupBy("block").applyInPandas(replay, f"{schema}, rr_order int")


def route_of(order) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in C.ROUTE_IDS]), (order + 1).cast("int"))


def policy_round_robin(cands: DataFrame, block_size: int = BLOCK_SIZE, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(txn_id, route_id) under R1..R4 rotation skipping ineligible routes."""
    masks = checkpointed(eligibility_mask(cands), "rr_masks")
    return (round_robin(masks, block_size, group_blocks).where(F.col("rr_order") >= 0)
            .select("txn_id", route_of(F.col("rr_order")).alias("route_id")))


# ------------------------------------------------------- all policies at once
def policy_choices(cands: DataFrame, eligibility: DataFrame, score: str = "p", tiebreak: str | None = None) -> DataFrame:
    """One row per transaction: actual outcome, eligible routes, each route's outcome, argmax and weighted choice."""
    dim = F.broadcast(weighted_split_dim(eligibility).select("payment_method", "network", "route_id", "lo", "hi"))
    u = uniform_of()
    hit = (u >= F.col("lo")) & ((u < F.col("hi")) | (F.col("hi") >= 1.0 - 1e-12))
    key = F.struct(F.col(score), *([F.col(tiebreak)] if tiebreak else []), (-F.col("route_order")).alias("neg_order"))
    of_route = [F.max(F.when(F.col("route_order") == i, F.col("outcome_proxy"))).alias(f"outcome{i}") for i in range(N_ROUTES)]
    return (cands.join(dim, ["payment_method", "network", "route_id"], "left").groupBy("txn_id")
            .agg(F.first("actual_success").alias("actual_success"),
                 F.sum(F.expr("shiftleft(1, route_order)")).cast("int").alias("mask"), *of_route,
                 F.max_by(F.struct("route_id", F.col(score).alias("p"), "outcome_proxy"), key).alias("best"),
                 F.max(F.when(hit, F.col("route_order"))).cast("int").alias("split_order")))


def policy_summary(cands: DataFrame, eligibility: DataFrame, score: str = "p", tiebreak: str | None = None,
                   block_size: int = BLOCK_SIZE, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(policy, success_rate, n_txn) of actual, round robin, argmax and weighted split, and candidate_rows."""
    rows = policy_choices(cands, eligibility, score, tiebreak).withColumn("best_outcome", F.col("best.outcome_proxy")).drop("best")
    rows = round_robin(checkpointed(rows, "choices"), block_size, group_blocks)
    outcome = F.array(*[F.col(f"outcome{i}") for i in range(N_ROUTES)])
    one = rows.agg(
        F.avg("actual_success").alias("s0"), F.count(F.lit(1)).alias("n0"),
        F.avg(F.when(F.col("rr_order") >= 0, F.get(outcome, F.col("rr_order")))).alias("s1"), F.count_if(F.col("rr_order") >= 0).alias("n1"),
        F.avg("best_outcome").alias("s2"), F.count(F.lit(1)).alias("n2"),
        F.avg(F.get(outcome, F.col("split_order"))).alias("s3"), F.count("split_order").alias("n3"),
        F.sum(F.bit_count("mask")).cast("long").alias("candidate_rows"))
    return one.select("candidate_rows", F.expr(
        "stack(4, 'actual', s0, n0, 'round_robin', s1, n1, 'model_argmax', s2, n2, 'weighted_split', s3, n3)")
        .alias("policy", "success_rate", "n_txn"))


# --------------------------------------------------------- weighted split
def weighted_split_dim(eligibility: DataFrame) -> DataFrame:
    """Eligibility rows with normalised cumulative weight intervals [lo, hi)."""
    w = F.create_map(*[x for k, v in C.ROUTE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    from pyspark.sql import Window
    win = Window.partitionBy("payment_method", "network").orderBy("route_order")
    e = eligibility.withColumn("w", w[F.col("route_id")])
    tot = F.sum("w").over(win.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cum = F.sum("w").over(win.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("payment_method", "network", "route_id", "route_order",
                    ((cum - F.col("w")) / tot).alias("lo"), (cum / tot).alias("hi"))


def uniform_of(txn_id_col: str = "txn_id"):
    """Deterministic pseudo-uniform in [0, 1) from the transaction id."""
    return ((F.col(txn_id_col) * 104729 + 12345) % 10007) / F.lit(10007.0)


def policy_weighted_split(txns: DataFrame, eligibility: DataFrame) -> DataFrame:
    """(txn_id, route_id) by weights .35/.25/.25/.15 renormalised over eligible routes."""
    dim = F.broadcast(weighted_split_dim(eligibility))
    u = uniform_of()
    last = F.col("hi") >= 1.0 - 1e-12
    return (txns.join(dim, ["payment_method", "network"])
            .where((u >= F.col("lo")) & ((u < F.col("hi")) | last))
            .select("txn_id", "route_id"))


def _ship_by_value() -> None:
    """Executors may not have this package installed: pickle the Arrow-batch
    helpers of this module by value so mapInPandas tasks are self-contained."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
