"""Offsets as DataFrames: the latest view of a commit log, and how positions move.

A log row has the consumer key, ``commit_seq`` and the offset columns; records are never changed in
place. Column names default to the declared offset schema.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import resume_or_first
from tidemark.functions.timestamps import as_bound, epoch, exact_text, to_instant
from tidemark.operators.dedup import drop_seen
from tidemark.plans.joins import attach_per_key, null_safe
from tidemark.plans.workspace import settle
from tidemark.schemas import CONSUMER_KEY, EVENT_ORDER


def latest_offsets(log: DataFrame, keys=CONSUMER_KEY, seq="commit_seq") -> DataFrame:
    """The newest record of each key; a key whose newest record is a tombstone is gone."""
    # The newest number of a key is a plain hash aggregate; carrying the record along would sort the log.
    newest = log.groupBy(*keys).agg(F.max(seq).alias("_newest"))
    rows = null_safe(log, newest, keys).filter(F.col(seq) == F.col("_newest")).drop("_newest")
    return rows.filter(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in rows.columns else rows


def load_offsets(log: DataFrame, wanted: DataFrame, ts="last_processed_timestamp", total="total_processed", keys=CONSUMER_KEY):
    """The record of every wanted key; the epoch and a count of 0 where there is none."""
    found = wanted.select(*keys).distinct().join(latest_offsets(log, keys), list(keys), "left")
    return found.withColumn(ts, F.coalesce(F.col(ts), epoch(log.schema[ts].dataType))).withColumn(
        total, F.coalesce(F.col(total), F.lit(0).cast("long"))
    )


def offset_exists(log: DataFrame, wanted: DataFrame, keys=CONSUMER_KEY) -> DataFrame:
    found = latest_offsets(log, keys).select(*keys).withColumn("found", F.lit(True))
    return (
        wanted.select(*keys).distinct().join(found, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))
    )


def delete_offsets(log: DataFrame, doomed: DataFrame, keys=CONSUMER_KEY, seq="commit_seq") -> DataFrame:
    """The log with a tombstone appended for every doomed key that has a record."""
    newest = latest_offsets(log, keys).join(doomed.select(*keys).distinct(), list(keys), "left_semi")
    stones = newest.withColumn(seq, F.col(seq) + 1).withColumn("deleted", F.lit(True))
    return log.unionByName(stones.select(*log.columns))


def pending_of_owner(events: DataFrame, offsets: DataFrame, keys=CONSUMER_KEY, order=EVENT_ORDER) -> DataFrame:
    """Events after the position of the consumer they belong to (offsets: keys, last_ts, last_id).

    A key without a record has no position yet, so all of its events are pending.
    """
    bounds = offsets.select(*keys, "last_ts", "last_id")
    joined = attach_per_key(events, bounds, keys, [order[1]])
    ts, tie = F.col(order[0]), F.col(order[1])
    return joined.filter(resume_or_first(ts, tie, F.col("last_ts"), F.col("last_id"))).drop("last_ts", "last_id")


def newest_per_key(events: DataFrame, keys=CONSUMER_KEY, order=EVENT_ORDER) -> DataFrame:
    """The newest (time, id) of each key and the key's number of events ``n``.

    The newest time is a plain hash aggregate. Only events at that time are then looked at for the
    id, and the earliest such time bounds the second scan; comparing pairs throughout would sort
    every row by its key. ``events`` is evaluated twice: settle it first if it is costly.
    """
    ts, kind = F.col(order[0]), events.schema[order[0]].dataType
    top = settle(events.groupBy(*keys).agg(F.max(ts).alias("_top"), F.count(F.lit(1)).alias("n")), "top")
    seen = top.agg(exact_text(F.min("_top"), kind).alias("low"), F.count(F.lit(1)).alias("keys")).first()
    last = events.select(*keys, *order)
    if seen.low is not None:
        last = last.filter(ts >= as_bound(seen.low, kind))
    per_key = top.select(*keys, "_top")
    at_top = attach_per_key(last, per_key, keys, [order[1]], "inner", counted=seen.keys).filter(ts == F.col("_top"))
    ids = at_top.groupBy(*keys).agg(F.max(order[1]).alias(order[1]))
    return null_safe(top, ids, keys).select(*keys, F.col("_top").alias(order[0]), order[1], "n")


def advance_offsets(events: DataFrame, offsets: DataFrame, keys=CONSUMER_KEY, order=EVENT_ORDER) -> DataFrame:
    """Every offset after its consumer has handled ``events``.

    The position is the larger of the stored and the newest handled (time, id) pair, so both parts
    come from one event and it never goes back. The total grows by the events handled.
    """
    handled = newest_per_key(events, keys, order).select(
        *keys,
        F.struct(F.col(order[0]).alias("last_ts"), F.col(order[1]).alias("last_id")).alias("_new"),
        F.col("n").alias("_n"),
    )
    stored = offsets.select(
        *keys, F.when(F.col("last_ts").isNotNull(), F.struct("last_ts", "last_id")).alias("_old"), "total"
    )
    return (
        null_safe(stored, handled, keys, "full")
        .withColumn("_at", F.greatest("_old", "_new"))
        .select(
            *keys,
            "_at.last_ts",
            "_at.last_id",
            (F.coalesce("total", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("total"),
        )
    )


def last_handled(events: DataFrame, handled_order, keys=("consumer_id",), order=EVENT_ORDER) -> DataFrame:
    """The position left by the event handled last, even when that is not the newest event."""
    at = F.struct(F.col(order[0]).alias("last_ts"), F.col(order[1]).alias("last_id"))
    return (
        events.groupBy(*keys)
        .agg(F.max(F.struct(F.struct(*handled_order).alias("turn"), at.alias("at"))).alias("last"))
        .select(*keys, "last.at.last_ts", "last.at.last_id")
    )


def last_handled_display(events: DataFrame, display, handled_order, keys=("consumer_id",), zone="UTC", order=EVENT_ORDER):
    """As :func:`last_handled`, for events that carry their time as text."""
    read = events.withColumn(order[0], to_instant(F.col(display), zone))
    return last_handled(read, handled_order, keys, order)


def increment_totals(totals: DataFrame, handled: DataFrame, keys=CONSUMER_KEY) -> DataFrame:
    """Stored totals plus the rows newly handled; a key without a record starts from 0."""
    counted = handled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return null_safe(totals, counted, keys, "full").select(
        *keys, (F.coalesce("total", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("total")
    )


def open_attempts(starts: DataFrame, dones: DataFrame, on=("consumer_id", "index_name", "attempt")) -> DataFrame:
    """Read attempts that were begun and not finished."""
    return starts.join(dones.select(*on), list(on), "left_anti")


def replay(events: DataFrame, ledger: DataFrame, to, epoch_no: int, on=("consumer_id", "index_name", "doc_id"), order=EVENT_ORDER):
    """What is pending after a seek to ``to``.

    Everything strictly later is due again; only what was handled since the seek (in its epoch)
    is left out. ``to`` None replays from the beginning.
    """
    if to is not None:
        events = events.filter(F.col(order[0]) > as_bound(to, events.schema[order[0]].dataType))
    return drop_seen(events, ledger, on, epoch_no)
