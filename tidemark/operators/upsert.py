"""Writing documents by id: the newest version wins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import content_id, payload, write_outcome
from tidemark.functions.timestamps import iso_text


def newest_per_id(incoming: DataFrame, version=None, key="doc_id") -> DataFrame:
    """The last version of each id within one batch. Copies merge before the shuffle.

    ``version`` names the column that orders them. Without it the latest ``timestamp`` wins (rows without one lose), and
    among equal times the greatest content, so the result does not depend on files and tasks.
    """
    rest = [c for c in incoming.columns if c != key]
    first = [c for c in ("timestamp",) if version is None and c in rest]
    order = F.col(version) if version else F.struct(*first, *[c for c in rest if c not in first])
    newest = incoming.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return newest.select(*[F.col(c) if c == key else F.col(f"row.{c}").alias(c) for c in incoming.columns])


def upsert(existing: DataFrame, incoming: DataFrame, key="doc_id") -> DataFrame:
    """Rows of ``existing`` that are not replaced, and all of ``incoming`` (one row per id)."""
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def upsert_outcome(existing: DataFrame, incoming: DataFrame, key="doc_id") -> DataFrame:
    """How many documents an upsert creates and how many it updates."""
    met = existing.select(F.col(key).alias("_existing"))
    return (
        incoming.join(met, F.col(key) == F.col("_existing"), "left")
        .groupBy(write_outcome(F.col("_existing")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ingest(raw: DataFrame, created_at=None) -> DataFrame:
    """Raw (event_type, user_id, optionally doc_id, queryid, timestamp, data) to declared events.

    What the sender left out is filled in: the creation time, a payload text, and an id hashed from
    the content so that a replay writes the same document again.
    """
    def given(name):
        return F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")

    stamp = F.current_timestamp() if created_at is None else created_at
    ts = F.coalesce(F.col("timestamp").cast("timestamp"), stamp) if "timestamp" in raw.columns else stamp
    stamped = raw.withColumn("timestamp", ts)
    body = F.coalesce(given("data"), payload(given("event_type"), given("user_id"), iso_text(F.col("timestamp"))))
    return stamped.select(
        F.coalesce(given("doc_id"), content_id(given("event_type"), given("user_id"), F.col("timestamp"), body)).alias("doc_id"),
        given("queryid").alias("queryid"),
        "timestamp",
        given("event_type").alias("event_type"),
        given("user_id").alias("user_id"),
        body.alias("data"),
    )
