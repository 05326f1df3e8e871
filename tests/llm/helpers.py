"""Hostile rows that every operator is shown."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # Columns whose names clash with those that operators make, one of them in another case only.
        T.StructField("score", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("TEXT", T.StringType()),
    ]
)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, "y", "z", "other") for i, t in rows], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
