import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, or longer rows."""

    def make(rows, lang="en", source="s"):
        full = [(*r, *(lang, source, len(r[1] or ""))[len(r) - 2 :]) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
