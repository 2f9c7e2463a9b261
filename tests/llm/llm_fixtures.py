"""Fixtures of these tests, imported by name; the Spark session is the suite's."""
import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as a documents table with extra columns."""
    def make(rows, extra=None):
        data = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, DOCS)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, value)
        return df
    return make


@pytest.fixture(scope="session")
def sf_texts():
    import pyarrow.parquet as pq
    t = pq.read_table(os.path.join(SF, "documents.parquet"), columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
