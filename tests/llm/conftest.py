import pytest
from pyspark.sql import types as T

#: Documents with one column more that operators must pass or leave alone.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs."""

    def make(rows, lang="en"):
        full = [(k, t, lang, "src0", None if t is None else len(t)) for k, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
