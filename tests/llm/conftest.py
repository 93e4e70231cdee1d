import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """Documents frame from (doc_id, text) pairs; extra columns clash with operator results on request."""
    def make(rows, **extra):
        from pyspark.sql import functions as F

        from tabsieve.llm.common import prepare
        prepare(spark)
        df = spark.createDataFrame([(i, t, "en", "src0", None) for i, t in rows], DOCS)
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df
    return make
