"""Small literal tables."""

from pyspark.sql import functions as F


def events(spark, rows):
    """rows: (doc_id, seconds since 2024-01-01) or (doc_id, seconds, event_type)."""
    full = [(r[0], float(r[1]), r[2] if len(r) > 2 else "view") for r in rows]
    base = spark.createDataFrame(full, "doc_id string, s double, event_type string")
    at = F.timestamp_micros(F.lit(T0) + (F.col("s") * 1_000_000).cast("long"))
    return base.select(
        "doc_id",
        F.lit(None).cast("string").alias("queryid"),
        at.alias("timestamp"),
        "event_type",
        F.lit("u").alias("user_id"),
        F.lit("d").alias("data"),
    )


T0 = 1_704_067_200_000_000  # 2024-01-01 in microseconds


def ids(df, column="doc_id"):
    return [r[column] for r in df.select(column).collect()]
