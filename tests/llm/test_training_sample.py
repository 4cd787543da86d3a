"""A long labelled text keeps no other out of the training sample."""

from pyspark.sql import functions as F

from routewise.llm import quality_classifier, toxicity
from routewise.llm.common import label_rows, training_texts

CLASS_BYTES = 20_000


def first_by_hash(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return [r["doc_id"] for r in rows.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").collect()]


def tables(spark, label, texts):
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, [t for _, t in texts])), "doc_id long, text string")
    labels = spark.createDataFrame(list(zip(ids, [y for y, _ in texts])), f"doc_id long, {label} int")
    return docs, labels


def test_long_texts_leave_room(spark):
    order = first_by_hash(spark, range(40))
    for long in ((order[0],), order[:3], tuple(order[:1] + order[5:9])):  # beyond the bound alone, or a few together
        size = CLASS_BYTES + 1 if len(long) == 1 else CLASS_BYTES // 2
        texts = {i: "b" * size if i in long else f"text {i}" for i in range(40)}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        rows = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, label int")
        found = [t for _, t in training_texts(docs, rows, 40, CLASS_BYTES)[0]]
        assert {texts[i] for i in order if i not in long} <= set(found)
        assert sum(map(len, found)) <= CLASS_BYTES
        short = [t for t in found if t.startswith("text")]
        assert short == [texts[i] for i in order if i not in long]  # order as before


def test_models_learn_beside_a_long_text(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [(i % 2, f"{words[i]} {words[i + 7]} {'idiot' if i % 2 else 'calm'} {words[i + 90]}") for i in range(200)]
    for label, module in (("quality", quality_classifier), ("toxic", toxicity)):
        docs, labels = tables(spark, label, texts)
        known = label_rows(labels, label, module.FOLDS, module.HELD_OUT)
        positive = {r["doc_id"] for r in known.where("label = 1").collect()}
        longest = next(i for i in first_by_hash(spark, range(200)) if i in positive)
        docs = docs.withColumn("text", F.when(F.col("doc_id") == longest, F.repeat(F.lit("long "), CLASS_BYTES)).otherwise(F.col("text")))
        model = module.fit(docs, labels, class_bytes=CLASS_BYTES)
        if module is toxicity:
            assert any("idiot".startswith(t[0]) for t in model.terms)
        else:
            assert model.weight.any()
