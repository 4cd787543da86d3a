"""Plan assertions: the fact table is shuffled once, state joins are broadcast,
no Python in the feature plan, scans prune columns."""

from conftest import SF_TINY

from routewise.plans.context import Ctx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_shape(spark):
    c = Ctx(spark, SF_TINY)
    f = c.features(True)
    plan = _plan(f)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # the events scan reads only the columns the binding needs
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double" in plan


def test_argmax_is_one_partial_aggregate(spark):
    from routewise.operators.policy import policy_argmax
    from routewise.plans.context import candidates
    c = Ctx(spark, SF_TINY)
    plan = _plan(policy_argmax(candidates(c)))
    assert "partial_max_by" in plan


def _ancestors(plan: str, needle: str) -> list[str]:
    """Operator lines above the first line containing ``needle`` in the tree string."""
    lines = plan.splitlines()
    i = next(k for k, ln in enumerate(lines) if needle in ln)
    depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
    out = []
    for ln in reversed(lines[:i]):
        d = len(ln) - len(ln.lstrip(" :+-"))
        if d < depth:
            out.append(ln.strip(" :+-"))
            depth = d
    return out


def _fact_exchanges(spark, sf, tick_seconds):
    """Exchanges above the fact scan of the final plan, with broadcast joins by size switched off."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        f = Ctx(spark, sf, tick_seconds=tick_seconds).features(True)
        f.write.format("noop").mode("overwrite").save()
        plan = _plan(f).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert plan.count("events.parquet") == 1
    return [x for x in _ancestors(plan, "events.parquet") if x.startswith("Exchange")]


def test_fact_table_scanned_once_and_shuffled_twice(spark):
    """One plan at every size: by (bank, txn block) for windows and prefixes, by the wide state's key."""
    for sf, tick in ((SF_TINY, 3600), ("/root/testdata/sf0.1", 60)):
        shuffles = _fact_exchanges(spark, sf, tick)
        assert len(shuffles) == 2, shuffles
        assert any("hashpartitioning(bank" in x and "block" in x for x in shuffles)


def test_policies_take_few_exchanges(spark):
    from routewise.plans.catalog import QUERIES
    plan = _plan(QUERIES["policy_success_rate"](spark, SF_TINY)).split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") < 15


def test_score_ranges_are_even(spark):
    """Ranges are cut at quantiles: crowded scores do not share one range."""
    from pyspark.sql import functions as F
    from routewise.operators.prefix import RANGES, ordered_prefix
    n = 40_000
    df = spark.range(n).select((1 - F.pow((F.col("id") + 1) / n, 8)).alias("s"), F.lit(1).alias("v"))
    out = ordered_prefix(df, "s", ["v"])
    assert out.agg(F.max("cum_v")).first()[0] == n
    assert out.orderBy("s").limit(3).select("cum_v").collect() == [(1,), (2,), (3,)]
    g = df.groupBy("s").agg(F.sum("v")).repartitionByRange(RANGES, "s").groupBy(F.spark_partition_id()).count()
    assert g.agg(F.max("count")).first()[0] <= 0.012 * n
