import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def make_docs(spark):
    """(doc_id, text[, source]) tuples to a documents table with columns whose names clash with internal ones."""
    def make(rows, extra=()):
        schema = T.StructType(DOCS.fields + [T.StructField(n, T.StringType()) for n in extra])
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) + ("x",) * len(extra) for r in rows]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
