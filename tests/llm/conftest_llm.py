"""Rows and frames shared by the tests of this folder."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
                      + [T.StructField(c, T.StringType()) for c in ("tag", "raw", "row", "set", "score", "spans", "form", "key", "kept", "ids")])


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, *["x"] * 10) for i, t, lang in rows], SCHEMA)


def prose(k, n=120):
    """Deterministic words that differ from one k to another."""
    return " ".join(f"w{(k * 7919 + j * 104729 + j * j * (k + 3)) % 9973}" for j in range(n))
