"""Skipping what was already handled, and keeping one copy of each event."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import EVENT_ORDER


def drop_seen(events: DataFrame, ledger: DataFrame, on=("consumer_id", "index_name", "doc_id"), epoch=None) -> DataFrame:
    """Events not in the ledger. ``epoch`` restricts it to rows written since the last seek.

    The ledger grows with the events, so it is never forced into a broadcast; the document id in
    the key keeps both sides evenly spread.
    """
    if epoch is not None:
        ledger = ledger.filter(F.col("epoch") == F.lit(epoch))
    return events.join(ledger.select(*on), list(on), "left_anti")


def processed_flag(events: DataFrame, ledger: DataFrame, on=("consumer_id", "index_name", "doc_id")) -> DataFrame:
    """Every event with ``processed``, derived from the ledger: the source is never written to."""
    handled = ledger.select(*on).distinct().withColumn("_hit", F.lit(True))
    return events.join(handled, list(on), "left").withColumn("processed", F.col("_hit").isNotNull()).drop("_hit")


def dedup_events(events: DataFrame, key=("doc_id",), order=EVENT_ORDER) -> DataFrame:
    """The earliest copy of each event.

    An aggregate rather than a window: copies merge before the shuffle, so an event that was sent
    very many times is no heavier than any other.
    """
    rank = F.struct(*[F.col(c) for c in order])
    rest = [c for c in events.columns if c not in key and c not in order]
    row = F.struct(rank.alias("rank"), *[F.col(c) for c in rest])
    kept = events.groupBy(*key).agg(F.min(row).alias("row"))
    picked = [F.col(c) if c in key else F.col(f"row.rank.{c}" if c in order else f"row.{c}").alias(c) for c in events.columns]
    return kept.select(*picked)
