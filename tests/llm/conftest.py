import pytest

CLASHING = ("score", "kept", "spans", "k1", "k2", "gone", "size", "key", "id", "shard", "slot", "node", "comp", "n",
            "bucket", "text_", "doc_", "label", "words", "sequence_id", "offset", "group_", "gone_id_", "at")


def _rows():
    long = "word " * 30_000 + "end"
    para = "one two three four five six\nseven eight nine ten\neleven twelve thirteen\nfourteen"
    texts = [(1, None), (2, ""), (3, "   \n\t\n"), (4, "hello"), (5, long), (6, para), (7, para), (7, para),
             (None, "text without an id"), (None, None), (8, "x" * 50_000), (9, "Ünïcode ß 日本 😀 a@b.co"), (10, "hello"),
             (11, para + "\nlast line here"), (12, " ".join(f"w{i}" for i in range(60)))]
    return [(d, t, None if i % 5 == 4 else "en", None if i % 4 == 3 else "src0", None if t is None else len(t))
            for i, (d, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(_rows(), SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def tiny():
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"create view {t} as from '/root/testdata/sf0.001/{t}.parquet'")
    return con
