import pytest
from pyspark.sql import types as T

#: Columns that clash with names inside the operators.
EXTRA = ("hash", "key", "n", "row", "base", "weight", "quality", "spans")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        kinds = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
        schema = T.StructType(kinds + [T.StructField(c, T.StringType()) for c in EXTRA])
        return spark.createDataFrame([(i, t, *[None] * len(EXTRA)) for i, t in zip(ids, texts)], schema)

    return make
