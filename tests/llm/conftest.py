import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that carry the names of the operators' own.
CLASHES = ("score", "label", "gram", "node", "key", "uid", "words", "block", "winner_id", "winner_key", "start", "held_out", "y", "n")


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang) rows, with extra columns of clashing names."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            df = df.selectExpr("*", *(f"'x' as {c}" for c in CLASHES))
        return df
    return make


@pytest.fixture
def save(tmp_path):
    """Writes tables under a folder that queries can read."""
    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return put
