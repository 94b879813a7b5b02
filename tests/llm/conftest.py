import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (doc_id, text[, lang, source]) to a table like ``documents``."""

    def make(*rows):
        filled = []
        for row in rows:
            doc_id, text, lang, source = (*row, *(None, None, None, None)[len(row) :])
            filled.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(filled, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
