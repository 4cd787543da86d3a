"""Schema-checked reading, raising validation, split pruning, and a saved pipeline against the one in memory."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY

from routewise.plans.context import Ctx


def test_attempts_file_is_checked(spark, tmp_path):
    from routewise.sources.bindings import ATTEMPTS_SCHEMA, read_attempts_file
    a = Ctx(spark, SF_TINY).attempts
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    a.select(*[F.col(f.name).cast(f.dataType) for f in ATTEMPTS_SCHEMA]).withColumn("more", F.lit(1)).write.parquet(good)
    assert read_attempts_file(spark, good).schema.names == ATTEMPTS_SCHEMA.names
    a.drop("bank").withColumn("tick", F.col("tick").cast("string")).write.parquet(bad)
    with pytest.raises(ValueError, match="tick: string instead of bigint.*bank: missing"):
        read_attempts_file(spark, bad)


def test_validation_raises_with_counts(spark):
    from routewise.operators.quality import require_valid
    c = Ctx(spark, SF_TINY)
    assert require_valid(c.attempts, c.routes, 720).count() == c.attempts.count()
    broken = c.attempts.withColumn("tick", F.when(F.col("txn_id") == 5, -1).otherwise(F.col("tick")))
    with pytest.raises(ValueError, match="negative_tick: 1"):
        require_valid(broken, c.routes, 720)


def test_split_filter_prunes_partitions(spark, tmp_path):
    from routewise.sources.sinks import read_features, write_features
    path = str(tmp_path / "features")
    write_features(Ctx(spark, SF_TINY).features(False), path)
    plan = read_features(spark, path, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_split" in plan


def test_saved_pipeline_scores_as_in_memory(spark, tmp_path):
    from routewise.operators import learn as LN
    from routewise.plans.catalog import scored
    prep = LN.Prepared(scored(Ctx(spark, SF_TINY), engineered=True))
    model = LN.fit(prep, {"maxIter": 4})
    calibrated = LN.calibrate(model, prep)
    LN.save_pipeline(model, calibrated, str(tmp_path / "p"), 0.16)
    again, calibrated_again, meta = LN.load_pipeline(spark, str(tmp_path / "p"))
    assert meta["threshold"] == 0.16
    a = {r.txn_id: (r.raw_p, r.p) for r in LN.score(model, calibrated, prep.test).collect()}
    b = {r.txn_id: (r.raw_p, r.p) for r in LN.score(again, calibrated_again, prep.test).collect()}
    assert a and a == b


def test_baseline_is_unweighted_with_its_own_inputs(spark):
    from routewise import constants as C
    from routewise.operators import learn as LN
    from routewise.plans.catalog import scored
    prep = LN.Prepared(scored(Ctx(spark, SF_TINY), engineered=True))
    model = LN.fit_baseline(prep, {"maxIter": 2})
    names = LN.encoded_names(model, prep.train)
    assert names[:15] == list(C.BASELINE_NUMERIC_FEATURES) and len(C.BASELINE_NUMERIC_FEATURES) + len(C.CATEGORICAL_FEATURES) == 22
    trees = model.stages[-1]
    assert not trees.isSet("weightCol") and trees.getOrDefault("stepSize") == 0.05 and LN.BASELINE_PARAMS["maxIter"] == 500
    assert LN.raw_scores(model, prep.test).where("raw_p is null").count() == 0


def test_tuning_reads_rows_that_were_encoded_once(spark, monkeypatch):
    from routewise.operators import learn as LN
    from routewise.plans.catalog import scored
    prep = LN.Prepared(scored(Ctx(spark, SF_TINY), engineered=True))
    indexed, plans = [], []
    fit_index, fit_trees = LN.StringIndexer.fit, LN.GBTClassifier.fit
    monkeypatch.setattr(LN.StringIndexer, "fit", lambda self, df: indexed.append(df) or fit_index(self, df))
    monkeypatch.setattr(LN.GBTClassifier, "fit", lambda self, df: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or fit_trees(self, df))
    rows = LN.tune(prep, n_iter=3, params={"maxIter": 2})
    assert len(rows) == 3 and len(indexed) == 1
    assert len(plans) == 3 and all("InMemoryRelation" in x and "scalar-subquery" not in x for x in plans)
    for r in rows:
        draw = {k: r[k] for k in LN.SEARCH_SPACE}
        alone = LN.validation_cost(LN.fit(prep, dict(draw, maxIter=2)), prep)
        assert abs(alone - r["validation_cost"]) < 1e-9


def test_a_model_scores_a_row_once_for_all_thresholds(spark):
    from pyspark.sql import functions as F
    from routewise.operators import evaluate as EV
    rows = [(1, 1.0, 2.0, p) for p in (0.99, 0.9, 0.98, 0.46, 0.0, None, float("nan"))]
    df = spark.createDataFrame(rows, "success int, amount double, route_cost_percent double, raw double")
    df = df.withColumn("p", F.expr("aggregate(array(raw), 0D, (a, v) -> a + v)"))   # stands for a model's score
    ts = EV.cost_sweep_thresholds()
    want: dict[int, int] = {}
    for *_, p in rows:   # a score that is missing reaches no threshold, one that is not a number all of them
        b = 0 if p is None else sum(1 for t in ts if p != p or 1.0 - p >= t)
        want[b] = want.get(b, 0) + 1
    buckets = EV.threshold_buckets(df, ts)
    assert {r.b: r.n for r in buckets.collect()} == want
    plan = buckets._jdf.queryExecution().optimizedPlan().toString()
    scores = [line for line in plan.splitlines() if "aggregate(" in line]
    assert len(scores) == 1 and "filter(" not in scores[0]
