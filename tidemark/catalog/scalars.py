"""Column jobs over whole tables."""

from pyspark.sql import functions as F

from tidemark.catalog.inputs import EV_SQL, ev, raw_events
from tidemark.catalog.progress import ISO_SQL
from tidemark.catalog.registry import query
from tidemark.functions import text
from tidemark.functions import timestamps as ts_fn

def _mixed(first, second):
    """By value: the one text, the other, and four kinds of junk by event type."""
    junk = (
        F.when(F.col("event_type") == "error", F.lit(""))
        .when(F.col("event_type") == "signup", F.lit("2025"))
        .when(F.col("event_type") == "view", F.lit("garbage"))
    )
    return F.when(F.col("value") < 20, first).when(F.col("value") < 60, second).otherwise(junk)


@query("SELECT event_id, CASE WHEN value < 60 THEN epoch_us(ts) // 1000 ELSE 0 END AS ts_ms FROM events")
def display_to_iso(spark, sf_dir):
    shown = _mixed(ts_fn.display_text(F.col("ts")), ts_fn.iso_text(F.col("ts")))
    texts = raw_events(spark, sf_dir).select("event_id", shown.alias("shown"))
    return texts.select("event_id", F.unix_millis(ts_fn.to_instant(F.col("shown"))).alias("ts_ms"))


@query(
    """SELECT event_id, CASE WHEN value < 60 THEN strftime(ts, '%b %-d, %Y @ %H:%M:%S.%g')
                             ELSE 'Jan 1, 1970 @ 00:00:00.000' END AS display FROM events"""
)
def iso_to_display(spark, sf_dir):
    given = _mixed(ts_fn.iso_text(F.col("ts")), ts_fn.display_text(F.col("ts")))
    texts = raw_events(spark, sf_dir).select("event_id", given.alias("given"))
    return texts.select("event_id", ts_fn.to_display(F.col("given")).alias("display"))


@query("SELECT event_id, consumer_id || '_' || index_name AS offset_key FROM ev", EV_SQL)
def offset_key(spark, sf_dir):
    key = text.offset_key(F.col("consumer_id"), F.col("index_name"))
    return ev(spark, sf_dir).select("event_id", key.alias("offset_key"))


@query(
    f"""SELECT event_id, 'Sample data for ' || event_type || ' event by ' || user_id || ' at ' || {ISO_SQL} AS payload
        FROM events"""
)
def payload_text(spark, sf_dir):
    body = text.payload(F.col("event_type"), F.col("user_id"), ts_fn.iso_text(F.col("ts")))
    return raw_events(spark, sf_dir).select("event_id", body.alias("payload"))


@query(
    """SELECT event_id, sha256(concat_ws(chr(31), '=' || event_id, '=' || event_type, '=' || user_id, '=' || props))
              AS content_id FROM events"""
)
def content_id(spark, sf_dir):
    parts = [F.col(c) for c in ("event_id", "event_type", "user_id", "props")]
    return raw_events(spark, sf_dir).select("event_id", text.content_id(*parts).alias("content_id"))
