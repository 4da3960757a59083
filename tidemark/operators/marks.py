"""Positions of many consumers over shared indexes.

A first narrow pass counts events per index and hour. From those counts follows which hours hold
any consumer's next events, so that only these are read, placed and ordered.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timestamps import as_bound, exact_text
from tidemark.plans.joins import BROADCAST_ROWS, attach_per_key
from tidemark.plans.workspace import settle

# More distinct positions than this in one group are handled by ranking instead.
MAX_MARKS = 256
BUCKET_SECONDS = 3600
# The bucket of a consumer that starts from nothing lies before all others.
BEFORE_ALL = -(2**62)


def bucket_of(ts, kind):
    """The hour of a time of the given type, counted from 1970 in UTC, whatever the session zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)
    return F.floor(F.unix_seconds(ts) / BUCKET_SECONDS).cast("long")


def bucket_counts(events: DataFrame, order, index: str) -> DataFrame:
    """Events per (index, hour) and the newest of them: as many rows as there are hours."""
    counted = events.groupBy(index, bucket_of(F.col(order[0]), events.schema[order[0]].dataType).alias("bucket"))
    return settle(counted.agg(F.count(F.lit(1)).alias("n"), F.max(order[0]).alias("newest")), "counts")


def milestones(counts: DataFrame, offsets: DataFrame, index: str) -> DataFrame:
    """The hours of each index with running counts, and the hours in which a consumer stands.

    ``anchor`` is the count up to and including the last such hour before this one.
    """
    stands = offsets.select(index, "bucket").distinct().withColumn("is_mark", F.lit(True))
    hours = counts.join(stands, [index, "bucket"], "full").select(
        index,
        "bucket",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("is_mark", F.lit(False)).alias("is_mark"),
    )
    w = W.partitionBy(index).orderBy("bucket")
    up_to = hours.withColumn("up_to", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    passed = F.last(F.when(F.col("is_mark"), F.col("up_to")), ignorenulls=True)
    return up_to.withColumn("anchor", passed.over(w.rowsBetween(W.unboundedPreceding, -1)))


def with_bucket(offsets: DataFrame) -> DataFrame:
    return offsets.withColumn("bucket", F.coalesce(bucket_of(F.col("last_ts"), offsets.schema["last_ts"].dataType), F.lit(BEFORE_ALL)))


class Positions(NamedTuple):
    """What is known of all positions: the most in one group, how many, and the earliest."""

    most: int
    all: int
    earliest: str | None  # None if a consumer starts from nothing

    def bounded(self, max_marks=None) -> bool:
        """Few enough, per group and in all, to send to every task?"""
        return self.most <= (MAX_MARKS if max_marks is None else max_marks) and self.all <= BROADCAST_ROWS


def look_at(offsets: DataFrame, group) -> Positions:
    stored = offsets.schema["last_ts"].dataType
    groups = offsets.groupBy(*group).agg(
        F.count("last_ts").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("last_ts").alias("ts")
    )
    row = groups.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("all"),
        F.when(F.sum("n") == F.sum("rows"), exact_text(F.min("ts"), stored)).alias("earliest"),
    ).first()
    return Positions(row.most, row.all, row.earliest)


def since(events: DataFrame, earliest, order) -> DataFrame:
    """Leave out what lies before every position."""
    if earliest is None:
        return events
    return events.filter(F.col(order[0]) >= as_bound(earliest, events.schema[order[0]].dataType))


def in_hours(events: DataFrame, hours: DataFrame, order, index: str) -> DataFrame:
    """The events of the given settled (index, bucket) rows. The span they cover bounds the scan."""
    span = hours.agg(
        F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.count(F.lit(1)).alias("rows")
    ).first()
    if span.rows == 0:
        return events.limit(0).withColumn("bucket", F.lit(BEFORE_ALL))
    ts, stored = F.col(order[0]), events.schema[order[0]].dataType
    first = as_bound(span.low * BUCKET_SECONDS * 1_000_000, stored)
    last = as_bound((span.high + 1) * BUCKET_SECONDS * 1_000_000, stored)
    bounded = events.filter((ts >= first) & (ts < last)).withColumn("bucket", bucket_of(ts, stored))
    return attach_per_key(bounded, hours, [index, "bucket"], [order[1]], "inner", counted=span.rows)


def mark_struct():
    """(time, tail, id). Tail 1 marks a time without an id: it lies after all events of that time."""
    return F.struct(
        F.col("last_ts").alias("ts"), F.col("last_id").isNull().cast("int").alias("tail"), F.col("last_id").alias("id")
    )


def marks_by(offsets: DataFrame, group) -> DataFrame:
    """Per group: its distinct positions in order."""
    return offsets.groupBy(*group).agg(
        F.array_sort(F.collect_set(F.when(F.col("last_ts").isNotNull(), mark_struct()))).alias("marks")
    )


def slot_of_event(order):
    """How many positions of the event's group lie before the event."""
    event = F.struct(F.col(order[0]).alias("ts"), F.lit(0).alias("tail"), F.col(order[1]).alias("id"))
    return F.size(F.filter("marks", lambda m: m < event))


def slot_of_mark():
    """The slot of the first events after a position (0 for a start from nothing)."""
    return F.when(F.col("last_ts").isNull(), F.lit(0)).otherwise(F.array_position("marks", mark_struct()).cast("int"))


def as_rank_marks(offsets: DataFrame, group, order) -> DataFrame:
    """Positions as rows that sort among the events."""
    return offsets.select(
        "consumer_id",
        *group,
        F.col("last_ts").alias(order[0]),
        F.col("last_id").alias(order[1]),
        (F.col("last_ts").isNotNull() & F.col("last_id").isNull()).cast("int").alias("_tail"),
    )
