"""The training-data pipeline: quality classifier, line dedup, near-dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
``docs``, with ``n_chars`` brought up to date where a stage changes texts.  Null, empty and repeated rows
are handled as each operator states; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm import line_dedup, minhash_dedup, packing, pii, quality_classifier
from routewise.llm.common import written
from routewise.sources.tables import read_table

#: The classifier is trained, and near-duplicate components are searched, so SQL cannot give these rows.
ORACLE_SQL = None
#: Similarity of near-duplicates in percent (op2's own is 85); these bands miss a pair at 0.80 with a chance of about 6 in 10^4.
NEAR_PERCENT, NEAR_ROWS, NEAR_BANDS = 80, 8, 40


def _sized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.score_column(spark, model) >= quality_classifier.KEEP_FROM)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; those with nothing left go."""
    return _sized(line_dedup.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.keep_one(docs, NEAR_PERCENT, NEAR_ROWS, NEAR_BANDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _sized(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_dedup", near_duplicates),
          ("pii", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
