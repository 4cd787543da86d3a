"""Model preparation, training, calibration and scoring with Spark ML.

Imputation statistics are computed as distributed aggregates and applied
with a broadcast of one row per feature (size bound = number of features).
The median is exact (interpolated, like a NaN-aware numpy median) without
collecting a column: values are counted per distinct value, bucketed by
value range per feature, and ranks come from prefix sums over buckets.
"""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routewise import constants as C
from routewise.operators import evaluate as EV
from routewise.operators.prefix import ranges_of
from routewise.plans.materialize import checkpointed

# The random-search space, mapped onto GBT parameters, and the published number of rounds.
SEARCH_SPACE = {
    "maxDepth": [3, 4, 5, 6, 8],
    "stepSize": [0.05, 0.08, 0.10],
    "minInstancesPerNode": [20, 50, 100],
    "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.7", "0.8", "0.9", "all"],
    "minInfoGain": [0.0, 0.001, 0.01],
    "class_weight_multiplier": [0.5, 0.75, 1.0, 1.5, 2.0, 3.0],
}
BASE_PARAMS = {"maxDepth": 5, "stepSize": 0.1, "maxIter": 500, "minInstancesPerNode": 20,
               "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInfoGain": 0.0,
               "class_weight_multiplier": 1.0}
#: The baseline: published rounds and rates, mapped in the same way; unweighted, with 15 + 7 inputs.
BASELINE_PARAMS = dict(BASE_PARAMS, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8")


# ----------------------------------------------------------------- impute
def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in cols])
    return df.select(F.explode(arr).alias("x")).select("x.*").where(F.col("value").isNotNull())


def exact_median(df: DataFrame, cols: Sequence[str], ranges: int | None = None) -> DataFrame:
    """M1 statistics: (feature, median) -- exact, interpolated for even counts.

    Distinct values are written in ranges of (feature, value) cut at sampled quantiles; ranks follow from
    the ranges' counts and a window inside each range.  Runs a Spark job (the write).
    """
    counts = _long(df, cols, "double").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts.repartitionByRange(ranges or ranges_of(df), "feature", "value")
                          .withColumn("b", F.spark_partition_id().cast("long")), "median_ranges")
    stats = counts.groupBy("feature").agg(F.sum("n").alias("total_n"))
    x = counts.join(F.broadcast(stats), "feature")   # one row per feature asked for
    tot = x.groupBy("feature", "b").agg(F.sum("n").alias("bn"))
    wb = Window.partitionBy("feature").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("feature", "b", F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("before_b"))
    wi = Window.partitionBy("feature", "b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    x = x.select("*", F.coalesce(F.sum("n").over(wi), F.lit(0)).alias("before_i")).join(tot, ["feature", "b"])
    first = F.col("before_b") + F.col("before_i")                 # rank of the first copy (0-based)
    lo_rank = F.floor((F.col("total_n") - 1) / 2)
    hi_rank = F.floor(F.col("total_n") / 2)
    covers = lambda r: (first <= r) & (r < first + F.col("n"))
    return x.groupBy("feature").agg(
        ((F.max(F.when(covers(lo_rank), F.col("value"))) + F.max(F.when(covers(hi_rank), F.col("value")))) / 2)
        .alias("median"))


def mode_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M2 statistics: (feature, mode) -- most frequent, ties -> smallest value."""
    counts = _long(df, cols, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def apply_fill(df: DataFrame, stats: DataFrame, value_col: str, cols: Sequence[str]) -> DataFrame:
    """Replace NULLs with fitted per-feature statistics.

    The fitted statistics are one value per feature (like a fitted imputer's
    ``statistics_``); they are brought to the driver and applied as literals,
    so scoring needs no join at all.
    """
    fitted = {r["feature"]: r[value_col] for r in stats.collect()}
    return df.select(*[F.coalesce(F.col(c), F.lit(fitted.get(c))).alias(c) if c in cols and fitted.get(c) is not None
                       else F.col(c) for c in df.columns])


# --------------------------------------------------------------- pipeline
#: Boosting rounds of the registered queries, which fit up to 20 models; the library's default is BASE_PARAMS.
QUERY_ROUNDS = {"maxIter": 40}


def build_pipeline(numeric: Sequence[str] = C.NUMERIC_FEATURES,
                   categorical: Sequence[str] = C.CATEGORICAL_FEATURES,
                   params: dict | None = None, weight_col: str | None = "weight",
                   validation_col: str | None = None) -> Pipeline:
    """M3 + M4 + M5/M7: index, one-hot (unknown -> all zeros), assemble, boosted trees."""
    p = dict(BASE_PARAMS, **(params or {}))
    idx = [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__idx" for c in categorical],
                         handleInvalid="keep", stringOrderType="alphabetAsc")]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=[f"{c}__vec" for c in categorical],
                        dropLast=True, handleInvalid="keep")
    asm = VectorAssembler(inputCols=list(numeric) + [f"{c}__vec" for c in categorical], outputCol="features",
                          handleInvalid="keep")
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=int(p["maxIter"]),
                        maxDepth=int(p["maxDepth"]), stepSize=float(p["stepSize"]),
                        minInstancesPerNode=int(p["minInstancesPerNode"]),
                        subsamplingRate=float(p["subsamplingRate"]),
                        featureSubsetStrategy=str(p["featureSubsetStrategy"]), minInfoGain=float(p["minInfoGain"]),
                        seed=42)
    if weight_col:
        gbt.setWeightCol(weight_col)
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[*idx, ohe, asm, gbt])


class Prepared:
    """Train/validation/test frames with imputation fitted on the training part only."""

    def __init__(self, scored_split: DataFrame):
        keep = ["txn_id", "tick", "split3", "success", "amount", "route_cost_percent",
                *C.NUMERIC_FEATURES, *C.BASELINE_NUMERIC_FEATURES, *C.CATEGORICAL_FEATURES]
        # The model matrix is read by every fit stage and boosting round:
        # materialise it once (reliable checkpoint) so nothing replays the
        # feature plan; statistics and fits all read the checkpoint.
        base = checkpointed(scored_split.select(*dict.fromkeys(keep))
                            .withColumn("label", F.col("success").cast("double")))
        train = base.where(F.col("split3") == "train")
        numeric = [c for c in dict.fromkeys([*C.NUMERIC_FEATURES, *C.BASELINE_NUMERIC_FEATURES]) if c != "tick"]   # never null
        self.medians = exact_median(train, numeric)
        self.modes = mode_values(train, C.CATEGORICAL_FEATURES)
        x = apply_fill(base, self.medians, "median", numeric)
        x = apply_fill(x, self.modes, "mode", C.CATEGORICAL_FEATURES)
        self.all = x
        self.train = x.where(F.col("split3") == "train")
        self.validation = x.where(F.col("split3") == "validation")
        self.test = x.where(F.col("split3") == "test")


class Encoded:
    """Training rows, with early stopping validation rows too, indexed, one-hot encoded and assembled once.

    A fit reads its rows several times (statistics, split points, bins, validation), and so does each further
    fit: the vectors are kept on the executors' disks until ``drop``, in the partitions of the prepared rows,
    which decide what a fit samples.  Memory is left to the bins of the fits.  The ratio of the classes is
    fetched (one row), so no fit aggregates it again.
    """

    def __init__(self, prep: Prepared, early_stop: bool = True, weighted: bool = True,
                 numeric: Sequence[str] = C.NUMERIC_FEATURES):
        self.numeric, self.weighted = numeric, weighted
        both = prep.train.unionByName(prep.validation) if early_stop else prep.train
        self.encoder = Pipeline(stages=build_pipeline(numeric).getStages()[:-1]).fit(both)
        self.train = self._kept(prep.train)
        self.validation = self._kept(prep.validation) if early_stop else None
        self.base_weight = EV.class_balance(self.train).first()["base_weight"] if weighted else None

    def _kept(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(df).select("label", "success", "amount", "route_cost_percent", "features").persist(
            StorageLevel.DISK_ONLY)

    def fit_trees(self, params: dict | None = None) -> GBTClassificationModel:
        """Boosted trees on the encoded rows."""
        p = dict(BASE_PARAMS, **(params or {}))
        data, val = self.train.withColumn("is_val", F.lit(False)), self.validation
        if self.weighted:
            data = data.withColumn("weight", EV.class_weight(F.lit(self.base_weight), float(p["class_weight_multiplier"])))
        if val is not None:
            val = val.withColumn("is_val", F.lit(True))
            data = data.unionByName(val.withColumn("weight", F.lit(1.0)) if self.weighted else val)
        trees = build_pipeline(self.numeric, params=p, weight_col="weight" if self.weighted else None,
                               validation_col=None if val is None else "is_val").getStages()[-1]
        return trees.fit(data)

    def drop(self) -> None:
        for df in (self.train, self.validation):
            if df is not None:
                df.unpersist()


def fit(prep: Prepared, params: dict | None = None, early_stop: bool = True, weighted: bool = True,
        numeric: Sequence[str] = C.NUMERIC_FEATURES) -> PipelineModel:
    """M6/M7: boosted trees, class-weighted unless told otherwise; validation rows drive early stopping."""
    encoded = Encoded(prep, early_stop, weighted, numeric)
    try:
        return PipelineModel([*encoded.encoder.stages, encoded.fit_trees(params)])
    finally:
        encoded.drop()


def fit_baseline(prep: Prepared, params: dict | None = None) -> PipelineModel:
    """M5: the baseline as published: unweighted, 22 inputs, fixed rounds without early stopping."""
    return fit(prep, dict(BASELINE_PARAMS, **(params or {})), early_stop=False, weighted=False, numeric=C.BASELINE_NUMERIC_FEATURES)


def raw_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """P(success) from the model as column raw_p."""
    out = model.transform(df)
    return out.withColumn("raw_p", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction",
        *[c for c in out.columns if c.endswith("__idx") or c.endswith("__vec")])


def validation_cost(model: PipelineModel | GBTClassificationModel, prep: Prepared | Encoded, raw: bool = True) -> float:
    """Best (minimum) validation cost per transaction over the cost sweep (one scan)."""
    v = raw_scores(model, prep.validation).withColumn("p", F.col("raw_p"))
    sw = EV.sweep(v, EV.cost_sweep_thresholds())
    return float(sw.agg(F.min("cost_per_txn")).first()[0])


def sample_params(n_iter: int, seed: int = 42) -> list[dict]:
    """M8: seeded random draws from the search space (driver-side, tiny)."""
    rng = random.Random(seed)
    keys = sorted(SEARCH_SPACE)
    return [{k: rng.choice(SEARCH_SPACE[k]) for k in keys} for _ in range(n_iter)]


def tune(prep: Prepared, n_iter: int = 20, seed: int = 42, parallelism: int = 4, params: dict | None = None) -> list[dict]:
    """M8: fit candidates concurrently over rows that are imputed and encoded once; keep min validation cost."""
    draws = sample_params(n_iter, seed)
    encoded = Encoded(prep)

    def one(i_p):
        i, p = i_p
        m = encoded.fit_trees(dict(p, **(params or {})))
        return dict(p, candidate=i, validation_cost=validation_cost(m, encoded))

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            return sorted(ex.map(one, enumerate(draws)), key=lambda r: (r["validation_cost"], r["candidate"]))
    finally:
        encoded.drop()


# -------------------------------------------------------------- importance
def encoded_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the assembled vector slots (numeric names; one-hot as feature_level)."""
    meta = model.transform(df.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    slots = []
    for group in meta.values():
        slots.extend((a["idx"], a["name"]) for a in group)
    names = [n for _, n in sorted(slots)]
    return [n.replace("__vec_", "_") for n in names]


def feature_importance(spark: SparkSession, model: PipelineModel, df: DataFrame) -> DataFrame:
    """M9: (feature, importance) -- one row per encoded column (bounded by the model width)."""
    names = encoded_names(model, df)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, [float(v) for v in imp])), "feature string, importance double")


def class_difference(df: DataFrame, cols: Sequence[str], label: str = "success") -> DataFrame:
    """(feature, importance) without a model: distance of the two classes' means in standard deviations, one aggregate."""
    def distance(c: str):
        means = [F.avg(F.when(F.col(label) == v, F.col(c))) for v in (1, 0)]
        return F.coalesce(F.abs(means[0] - means[1]) / F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(0.0))

    one = df.agg(*[distance(c).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in cols])).alias("x")).select("x.*")


def importance_share(imp: DataFrame) -> DataFrame:
    """Summed importance per feature and percent of the total."""
    g = imp.groupBy("feature").agg(F.sum("importance").alias("importance"))
    total = g.agg(F.sum("importance")).scalar()
    return g.select("feature", "importance", (F.col("importance") / total * 100.0).alias("importance_pct"))


def top_importance(imp: DataFrame, k: int = 30) -> DataFrame:
    """K2: top-k features by importance (TakeOrderedAndProject)."""
    return importance_share(imp).orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


# -------------------------------------------------------------- calibration
def calibrate(model: PipelineModel, prep: Prepared):
    """Isotonic regression of the label on validation raw scores (clips outside)."""
    return isotonic(raw_scores(model, prep.validation), "raw_p", "label")


def isotonic(df: DataFrame, score: str, label: str):
    """M10 on any score column."""
    return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="p").fit(df)


def score(model: PipelineModel, calibrator, df: DataFrame) -> DataFrame:
    """raw_p from the model, p = calibrated probability."""
    return calibrator.transform(raw_scores(model, df.drop("p")))


def save_pipeline(model: PipelineModel, calibrator, path: str, threshold: float) -> None:
    """SNK3: model + calibrator + decision metadata under one folder."""
    model.write().overwrite().save(f"{path}/model")
    calibrator.write().overwrite().save(f"{path}/calibrator")
    meta = {"threshold": threshold, "numeric_features": list(C.NUMERIC_FEATURES),
            "categorical_features": list(C.CATEGORICAL_FEATURES)}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "metadata string").coalesce(1).write.mode("overwrite").json(
        f"{path}/metadata")


def load_pipeline(spark: SparkSession, path: str):
    from pyspark.ml.regression import IsotonicRegressionModel
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
    return PipelineModel.load(f"{path}/model"), IsotonicRegressionModel.load(f"{path}/calibrator"), meta
