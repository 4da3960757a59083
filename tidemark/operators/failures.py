"""Stopping at the first event that failed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.joins import attach_per_key
from tidemark.schemas import EVENT_ORDER


def prefix_before_failure(events: DataFrame, ok, keys=("consumer_id",), order=EVENT_ORDER) -> DataFrame:
    """Per key, the events before its first failure: these are done, the rest is retried.

    An unknown outcome is no success.
    """
    at = F.struct(*[F.col(c) for c in order])
    failed = events.filter(~F.coalesce(ok, F.lit(False))).groupBy(*keys).agg(F.min(at).alias("_stop"))
    joined = attach_per_key(events, failed, keys, [order[1]])
    return joined.filter(F.col("_stop").isNull() | (at < F.col("_stop"))).drop("_stop")
