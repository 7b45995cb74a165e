"""Small documents with the awkward cases, for all operators."""

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def texts(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
