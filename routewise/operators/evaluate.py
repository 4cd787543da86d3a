"""Model evaluation on a scored frame (columns p = P(success), success, amount,
route_cost_percent).  Every metric is an aggregate over the frame; threshold
sweeps and curves are one scan plus work on tables of thresholds or
distinct scores, never a rescan per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.operators.prefix import DEFAULT_BLOCK_SIZE, ordered_prefix
from routewise.plans.materialize import checkpointed

def failure_prob(p: str = "p") -> Column:
    return F.lit(1.0) - F.col(p)


def cost_sweep_thresholds() -> list[float]:
    """0.02, 0.04, ..., 0.54 rounded to 3 dp (27 values)."""
    return [round(C.COST_SWEEP_START + C.COST_SWEEP_STEP * k, 3) for k in range(C.COST_SWEEP_COUNT)]


def calibration_edges() -> list[float]:
    """Bin edges 0.0, 0.1, ..., 1.0 as k * 0.1 (the float values a numpy arange gives)."""
    return [k * 0.1 for k in range(C.CALIBRATION_BINS + 1)]


# ------------------------------------------------------------- data split
def split_boundary(attempts: DataFrame, train_ticks: Column, block_size: int = DEFAULT_BLOCK_SIZE):
    """W16 boundary: (tick, txn_id) of the first validation row, or None.

    Train rows are ordered by (tick, txn_id); the first int(0.8 n) stay in
    train.  The boundary row is located from per-tick counts, then per-block
    counts inside that tick, then a rank inside one block -- only small
    tables and at most ``block_size`` rows are ever ordered; each step
    fetches one row.
    """
    tr = attempts.where(F.col("tick") < train_ticks).select("tick", "txn_id")
    per_tick = tr.groupBy("tick").agg(F.count(F.lit(1)).alias("n_t"))
    w = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()          # the per-tick table: one row per tick
    x = per_tick.select("tick", "n_t", F.sum("n_t").over(w).alias("cum"), F.sum("n_t").over(every).alias("n"))
    x = x.withColumn("cut", (F.col("n") * F.lit(1.0 - C.VALIDATION_FRACTION)).cast("long"))
    hit = (x.where((F.col("cum") > F.col("cut")) & (F.col("cum") - F.col("n_t") <= F.col("cut")))
           .select("tick", (F.col("cut") - (F.col("cum") - F.col("n_t"))).alias("k")).first())
    if hit is None:                       # no training rows, or nothing left for validation
        return None
    tick_star, k = hit["tick"], hit["k"]
    rows = tr.where(F.col("tick") == tick_star).withColumn("block", F.expr(f"txn_id div {int(block_size)}"))
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n_b"))
    wb = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    bhit = (blocks.select("block", "n_b", F.sum("n_b").over(wb).alias("cum"))
            .where((F.col("cum") > k) & (F.col("cum") - F.col("n_b") <= k))
            .select("block", (F.lit(k) - (F.col("cum") - F.col("n_b"))).alias("kb")).first())
    inner = rows.where(F.col("block") == bhit["block"]).select(
        "txn_id", (F.row_number().over(Window.partitionBy("block").orderBy("txn_id")) - 1).alias("r"))
    return tick_star, inner.where(F.col("r") == bhit["kb"]).first()["txn_id"]


def split_three(features: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE,
                attempts: DataFrame | None = None, train_ticks: Column | None = None) -> DataFrame:
    """Train rows ordered by (tick, txn_id); the last 20 % become validation.

    Applied as a comparison with the boundary key, so the feature table is
    never joined or sorted for it.
    """
    if attempts is None:
        attempts = features.select("txn_id", "tick", "dataset_split")
        train_ticks = F.lit(attempts.where(F.col("dataset_split") == "test").agg(F.min("tick")).first()[0])
    bd = split_boundary(attempts, train_ticks, block_size)
    if bd is None:
        return features.withColumn("split3", F.when(F.col("dataset_split") == "test", "test").otherwise("train"))
    bt, bx = bd
    before = (F.col("tick") < bt) | ((F.col("tick") == bt) & (F.col("txn_id") < bx))
    label = F.when(F.col("dataset_split") == "test", "test").when(before, "train").otherwise("validation")
    return features.withColumn("split3", label)


def class_balance(train: DataFrame) -> DataFrame:
    """Failures, successes, failure ratio, base weight succ/fail."""
    f = F.count_if(F.col("success") == 0)
    s = F.count_if(F.col("success") == 1)
    return train.agg(f.alias("failures"), s.alias("successes"),
                     (f / F.count(F.lit(1))).alias("failure_ratio"), (s / f).alias("base_weight"))


def class_weight(base_weight: Column, multiplier: float = 1.0) -> Column:
    """A row's weight, given succ/fail of the training rows."""
    return F.when(F.col("success") == 0, base_weight * F.lit(multiplier)).otherwise(F.lit(1.0))


def class_weights(train: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """M6: failure rows weigh succ/fail x multiplier, successes 1."""
    return train.withColumn("weight", class_weight(class_balance(train).select("base_weight").scalar(), multiplier))


# -------------------------------------------------------- fixed threshold
def confusion_counts(df: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """G12 source: one row tp, fp, tn, fn (positive = failure)."""
    pred = failure_prob(p) >= F.lit(threshold)
    fail = F.col("success") == 0
    return df.agg(F.count_if(fail & pred).alias("tp"), F.count_if(~fail & pred).alias("fp"),
                  F.count_if(~fail & ~pred).alias("tn"), F.count_if(fail & ~pred).alias("fn"))


def confusion_matrix(df: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Rows (actual, predicted, n) with labels 0 = failure, 1 = success."""
    pred = (~(failure_prob(p) >= F.lit(threshold))).cast("int")
    base = df.select(F.col("success").alias("actual"), pred.alias("predicted"))
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted")) for a in (0, 1) for b in (0, 1)])
    counts = base.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*")
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return prec, rec, f1


def classification_report(df: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Per-class precision/recall/F1/support, macro and weighted averages, accuracy."""
    cc = confusion_counts(df, threshold, p)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p0, r0, f0 = _prf(tp, fp, fn)        # class 0 = failure
    p1, r1, f1 = _prf(tn, fn, fp)        # class 1 = success
    s0, s1 = tp + fn, tn + fp
    n = s0 + s1
    def row(label, pr, rc, f, sup):
        return F.struct(F.lit(label).alias("label"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        sup.cast("long").alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", none, none, (tp + tn) / n, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n),
    )
    return cc.select(F.explode(rows).alias("r")).select("r.*")


def cost_at_threshold(df: DataFrame, threshold: float, p: str = "p",
                      fc_fixed: float = C.FAILURE_COST_FIXED, fc_pct: float = C.FAILURE_COST_PCT_OF_AMOUNT) -> DataFrame:
    """FN 50 + 2 % amount; FP forgone fee; TN -fee; TP 0; total and per transaction."""
    pred = failure_prob(p) >= F.lit(threshold)
    fail = F.col("success") == 0
    fee = F.col("amount") * F.col("route_cost_percent") / 100.0
    cost = (F.when(fail & ~pred, fc_fixed + F.col("amount") * fc_pct)
            .when(~fail & pred, fee).when(~fail & ~pred, -fee).otherwise(F.lit(0.0)))
    return df.agg(F.lit(threshold).alias("threshold"), F.sum(cost).alias("total_cost"),
                  (F.sum(cost) / F.count(F.lit(1))).alias("cost_per_txn"))


# ------------------------------------------------------ threshold sweeps
def threshold_buckets(df: DataFrame, thresholds: Sequence[float], p: str = "p") -> DataFrame:
    """One scan: b = #thresholds t (ascending) with 1 - p >= t; aggregate per (b, class).

    A row is predicted failure at threshold j exactly when b > j, so every
    per-threshold count/sum is a sum over buckets -- exact, no rescan.
    """
    ts = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    fp = failure_prob(p)
    # Named twice, the score stays a column; else the optimizer moves a model into the lambda, once per threshold.
    b = F.when(F.col(p).isNull(), F.lit(0)).otherwise(F.size(F.filter(ts, lambda t: fp >= t)))
    fee = F.col("amount") * F.col("route_cost_percent") / 100.0
    return (df.select(b.alias("b"), F.col("success").alias("y"), "amount", fee.alias("fee"))
            .groupBy("b", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"),
                                   F.sum("fee").alias("fee")))


def sweep(df: DataFrame, thresholds: Sequence[float], p: str = "p",
          multipliers: Sequence[float] = (1.0,)) -> DataFrame:
    """Per (multiplier, threshold) cost and failure-class metrics."""
    ts = sorted(thresholds)
    bk = threshold_buckets(df, ts, p)
    grid = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(t)).alias("threshold"), F.lit(float(m)).alias("mult"))
                     for j, t in enumerate(ts) for m in multipliers])
    x = bk.select("*", F.explode(grid).alias("g")).select("*", "g.*").drop("g")
    pred = F.col("b") > F.col("j")
    fail = F.col("y") == 0

    def s(cond, col="n"):
        return F.sum(F.when(cond, F.col(col)).otherwise(F.lit(0)))

    agg = x.groupBy("mult", "j", "threshold").agg(
        s(fail & pred).alias("tp"), s(~fail & pred).alias("fp"), s(~fail & ~pred).alias("tn"),
        s(fail & ~pred).alias("fn"),
        s(fail & ~pred, "amount").alias("fn_amount"), s(~fail & pred, "fee").alias("fp_fee"),
        s(~fail & ~pred, "fee").alias("tn_fee"))
    tp, fp_, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec, rec, f1 = _prf(tp, fp_, fn)
    n = tp + fp_ + tn + fn
    cost = (fn * F.lit(C.FAILURE_COST_FIXED) * F.col("mult")
            + F.col("fn_amount") * F.lit(C.FAILURE_COST_PCT_OF_AMOUNT) * F.col("mult")
            + F.col("fp_fee") - F.col("tn_fee"))
    return agg.select("mult", "threshold", cost.alias("total_cost"), (cost / n).alias("cost_per_txn"),
                      prec.alias("failure_precision"), rec.alias("failure_recall"), f1.alias("failure_f1"),
                      ((tp + tn) / n).alias("accuracy"), (tp + fp_).alias("predicted_failures"))


def best_by_cost(sw: DataFrame, group: Sequence[str] = ("mult",)) -> DataFrame:
    """Minimum cost per group; ties -> lowest threshold (first in sweep order)."""
    key = F.struct(F.col("cost_per_txn"), F.col("threshold"))
    return sw.groupBy(*group).agg(F.min_by(F.struct(*[c for c in sw.columns if c not in group]), key).alias("b")) \
        .select(*group, "b.*")


def constrained_cost_threshold(sw: DataFrame, target_recall: float = C.TARGET_FAILURE_RECALL) -> DataFrame:
    """Cheapest threshold whose failure recall >= target (empty if none)."""
    return best_by_cost(sw.where(F.col("failure_recall") >= target_recall).where(F.col("mult") == 1.0), ("mult",))


# ------------------------------------------------------------- curves
def pr_curve(df: DataFrame, p: str = "p") -> DataFrame:
    """precision/recall of the failure class at every distinct failure score."""
    x = df.select(failure_prob(p).alias("threshold"),
                  (F.col("success") == 0).cast("long").alias("pos"),
                  (F.col("success") == 1).cast("long").alias("neg"))
    cum = ordered_prefix(x, "threshold", ["pos", "neg"], descending=True)
    total_pos = x.agg(F.sum("pos")).scalar()
    tps, fps = F.col("cum_pos"), F.col("cum_neg")
    return cum.select("threshold",
                      F.when(tps + fps > 0, tps / (tps + fps)).otherwise(F.lit(0.0)).alias("precision"),
                      F.when(total_pos > 0, tps / total_pos).otherwise(F.lit(1.0)).alias("recall"))


def best_f1_threshold(pr: DataFrame) -> DataFrame:
    """Argmax F1 (eps 1e-12 in the denominator); ties -> lowest threshold."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-12))
    key = F.struct(f1, -F.col("threshold"))
    return pr.agg(F.max_by(F.struct("threshold", "precision", "recall", f1.alias("f1")), key).alias("b")).select("b.*")


def target_recall_threshold(pr: DataFrame, target: float = C.TARGET_FAILURE_RECALL) -> DataFrame:
    """Among thresholds with recall >= target, max precision; tie -> higher threshold."""
    key = F.struct(F.col("precision"), F.col("threshold"))
    return (pr.where(F.col("recall") >= target)
            .agg(F.max_by(F.struct("threshold", "precision", "recall"), key).alias("b"))
            .where(F.col("b").isNotNull()).select("b.*"))


def roc_auc(df: DataFrame, p: str = "p") -> DataFrame:
    """Rank AUC of P(success) with tied scores counted half."""
    x = df.select(F.col(p).alias("s"), (F.col("success") == 1).cast("long").alias("pos"),
                  (F.col("success") == 0).cast("long").alias("neg"))
    cum = ordered_prefix(x, "s", ["pos", "neg"])
    neg_below = F.col("cum_neg") - F.col("neg")
    num = cum.agg(F.sum(F.col("pos") * (neg_below + 0.5 * F.col("neg"))).alias("u"))
    pn = x.agg((F.sum("pos") * F.sum("neg")).cast("double")).scalar()
    return num.select((F.col("u") / pn).alias("roc_auc"))


def average_precision(df: DataFrame, p: str = "p") -> DataFrame:
    """Step-wise average precision of the success class (sum dR * P)."""
    x = df.select(F.col(p).alias("s"), (F.col("success") == 1).cast("long").alias("pos"),
                  (F.col("success") == 0).cast("long").alias("neg"))
    cum = ordered_prefix(x, "s", ["pos", "neg"], descending=True)
    total = x.agg(F.sum("pos")).scalar()
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return cum.agg((F.sum(F.col("pos") * prec) / total).alias("average_precision"))


def metric_bundle(df: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """(metric, value) rows from two reads of the frame.

    One gives the ordered prefix over distinct scores, from which rank AUC and average precision both
    follow (sums from above are totals less sums from below); one aggregate gives all the others.
    """
    x = df.select(F.col(p).alias("s"), (F.col("success") == 1).cast("long").alias("pos"),
                  (F.col("success") == 0).cast("long").alias("neg"))
    cum = checkpointed(ordered_prefix(x, "s", ["pos", "neg"]), "score_ranks")
    tp_all, tn_all = (cum.agg(F.sum(x)).scalar() for x in ("pos", "neg"))
    above_pos = tp_all - F.col("cum_pos") + F.col("pos")
    above_neg = tn_all - F.col("cum_neg") + F.col("neg")
    ranks = checkpointed(cum.agg(
        (F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg")))
         / F.max(tp_all.cast("double") * tn_all)).alias("roc_auc"),
        (F.sum(F.col("pos") * above_pos / (above_pos + above_neg)) / F.max(tp_all)).alias("average_precision")), "ranks")
    pred = failure_prob(p) >= F.lit(threshold)
    fail = F.col("success") == 0
    one = df.agg(*_proper(threshold, p), F.count_if(fail & pred).alias("tp"), F.count_if(~fail & pred).alias("fp"),
                 F.count_if(fail & ~pred).alias("fn"))
    prec, rec, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    one = one.select("log_loss", "brier", "accuracy", prec.alias("failure_precision"), rec.alias("failure_recall"),
                     f1.alias("failure_f1"))
    both = one.select(*(ranks.select(c).scalar().alias(c) for c in ranks.columns), "*")
    names = both.columns
    return both.select(F.expr("stack({}, {}) as (metric, value)".format(
        len(names), ", ".join(f"'{n}', cast({n} as double)" for n in names))))


def _proper(threshold: float, p: str) -> list[Column]:
    eps = 2.220446049250313e-16
    pc = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    y = F.col("success").cast("double")
    ll = -(y * F.log(pc) + (1 - y) * F.log(1 - pc))
    pred = (~(failure_prob(p) >= F.lit(threshold))).cast("int")
    return [F.avg(F.pow(F.col(p) - y, 2)).alias("brier"), F.avg(ll).alias("log_loss"),
            F.avg((pred == F.col("success")).cast("double")).alias("accuracy")]


def proper_scores(df: DataFrame, threshold: float = 0.5, p: str = "p") -> DataFrame:
    """Brier, log loss (p clipped to [eps, 1-eps]) and accuracy at a threshold."""
    return df.agg(*_proper(threshold, p))


def calibration_bins(df: DataFrame, p: str = "p", parity: bool = False) -> DataFrame:
    """10 equal-width bins of p: n, mean p, actual rate, gap; empty bins omitted.

    p = 1.0 falls in the closed last bin; ``parity=True`` drops it instead.
    """
    edges = calibration_edges()
    inner = F.array(*[F.lit(e) for e in edges[1:]])
    b = F.size(F.filter(inner, lambda e: F.col(p) >= e))
    if not parity:
        b = F.least(b, F.lit(len(edges) - 2))
    x = df.select(b.alias("bin"), F.col(p).alias("p"), "success").where(F.col("bin") < len(edges) - 1)
    labels = F.create_map(*[v for i in range(len(edges) - 1)
                            for v in (F.lit(i), F.lit(f"[{edges[i]:.1f}-{edges[i + 1]:.1f})"))])
    g = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("success").alias("ar"))
    return g.select("bin", labels[F.col("bin")].alias("bin_label"), "n",
                    F.round("mp", 4).alias("mean_predicted_prob"), F.round("ar", 4).alias("actual_success_rate"),
                    F.round(F.col("mp") - F.col("ar"), 4).alias("gap"))


# ------------------------------------------------------------- episodes
def incident_episodes(route_state: DataFrame) -> DataFrame:
    """Contiguous flagged ticks per route -> start, end, duration (gaps and islands)."""
    f = route_state.where(F.col("route_flagged_down") == 1.0).select("route_id", "tick")
    grp = F.col("tick") - F.row_number().over(Window.partitionBy("route_id").orderBy("tick"))
    return (f.select("route_id", "tick", grp.alias("g")).groupBy("route_id", "g")
            .agg(F.min("tick").alias("start_tick"), F.max("tick").alias("end_tick"),
                 F.count(F.lit(1)).alias("duration")).drop("g"))
