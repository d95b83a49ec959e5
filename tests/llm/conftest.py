import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark, tmp_path):
    """A stored documents table of (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows, partitions=3):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] else None) for r in rows]
        path = str(tmp_path / "documents.parquet")
        spark.createDataFrame(full, DOCS).repartition(partitions).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def tables():
    import duckdb

    con = duckdb.connect()
    return lambda name: con.execute(f"SELECT * FROM '{SF}/{name}.parquet'").fetch_df()
