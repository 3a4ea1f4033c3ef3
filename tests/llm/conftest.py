import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows that every operator must take: nulls in each column, empty and blank texts, ties, repeated rows, one long text.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "  \n\t ", "en", "b", 5),
    (5, "Alpha beta gamma delta epsilon zeta.", "en", "b", 36), (5, "Alpha beta gamma delta epsilon zeta.", "en", "b", 36), (None, "no id here", "en", "a", 10),
    (7, "word " * 30_000, "en", "c", 150_000), (8, "été über 漢字 \U0001f600 ok", "fr", "b", 20), (9, "x", "en", "b", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, DOCS).repartition(3)
    # names that operators use inside must not clash with a caller's
    return frame.withColumns({n: F.lit(1) for n in ("size", "digest", "recipe", "bands", "rank", "bucket", "_key", "_cell", "label", "x", "target")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
