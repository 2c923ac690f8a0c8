import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from texts, or from (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            row = (i, row) if row is None or isinstance(row, str) else row
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def written(tmp_path_factory):
    """A folder in which tables are written as an input of the queries."""

    def write(**tables):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
