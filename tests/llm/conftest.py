import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) or (id, text, source) tuples."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], SCHEMA)

    return make


@pytest.fixture
def odd(docs_of):
    """Nulls, empty and very long texts, ties, repeated rows and ids."""
    long = " ".join(f"word{i % 997}x{i}" for i in range(40_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (3, ""), (4, long), (None, "no id here at all"), (None, None), (5, " \n\t \n"), (6, "x" * 200_000), (2**60 + 1, "big id with null source", None)]
    return docs_of(*rows)


@pytest.fixture
def labels_of(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")

    return make
