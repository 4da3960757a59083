"""Sources, filters, projections and bounded reads."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.inputs import (
    AFTER_SEQ,
    BOUND,
    EV_SQL,
    K,
    LED_SQL,
    OFF_SQL,
    ORDER,
    OWNER,
    PREFIX,
    RAW,
    at,
    by_minute,
    ev,
    ledger,
    offsets,
    raw_events,
)
from tidemark.catalog.registry import query
from tidemark.functions import predicates as P
from tidemark.functions import text
from tidemark.functions.timestamps import exact_text, safe_start
from tidemark.operators import fetch
from tidemark.operators.dedup import drop_seen
from tidemark.operators.offsets import pending_of_owner
from tidemark.operators.reports import offset_lag, table_stats
from tidemark.plans.workspace import fresh_path
from tidemark.sources.events import decode_documents, scan_if_present
from tidemark.sources.tables import to_declared


@query("SELECT event_id, ts, user_id, event_type, props FROM events")
def scan_events(spark, sf_dir):
    return raw_events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "props")


@query(
    "SELECT event_id, event_type FROM ev WHERE event_type NOT IN ('error', 'signup')",
    EV_SQL,
)
def decode_documents_query(spark, sf_dir):
    """Error events have no body, signup events one that is cut off."""
    body = F.to_json(F.struct("event_id", "event_type", "user_id", "value", "props"))
    documents = raw_events(spark, sf_dir).select(
        F.when(F.col("event_type") == "error", F.lit(None))
        .when(F.col("event_type") == "signup", F.substring(body, 1, 9))
        .otherwise(body)
        .alias("body")
    )
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    return decode_documents(documents, schema, required="event_id")


@query("SELECT doc_id, ts, event_type, user_id::VARCHAR AS user_id, props AS data FROM ev", EV_SQL)
def declared_schema(spark, sf_dir):
    declared = T.StructType(
        [
            T.StructField("doc_id", T.StringType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("user_id", T.StringType()),
            T.StructField("data", T.StringType()),
        ]
    )
    return to_declared(ev(spark, sf_dir).withColumnRenamed("props", "data"), declared)


@query("SELECT count(*) AS docs FROM events")
def table_stats_query(spark, sf_dir):
    return table_stats(raw_events(spark, sf_dir)).select("docs")


@query("SELECT count(*) AS docs, true AS has_bytes FROM events")
def table_bytes(spark, sf_dir):
    """How many bytes are stored depends on the files, which SQL over a view cannot see."""
    return table_stats(raw_events(spark, sf_dir)).select("docs", (F.col("bytes") > 0).alias("has_bytes"))


@query("SELECT count(*) AS present, 0::BIGINT AS n FROM events")
def empty_source(spark, sf_dir):
    """The event table, and a table that is not there yet."""
    present = raw_events(spark, sf_dir).agg(F.count(F.lit(1)).alias("present"))
    absent = scan_if_present(spark, fresh_path(spark, "absent"), RAW).agg(F.count(F.lit(1)).alias("n"))
    rows = present.withColumn("n", F.lit(None).cast("long")).unionByName(absent.withColumn("present", F.lit(None).cast("long")))
    return rows.agg(F.max("present").alias("present"), F.max("n").alias("n"))


@query(f"SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '{BOUND}'")
def events_after(spark, sf_dir):
    return raw_events(spark, sf_dir).filter(P.after(F.col("ts"), at(BOUND))).select("event_id", "ts")


@query(f"SELECT event_id, ts FROM ev WHERE starts_with(doc_id, '{PREFIX}')", EV_SQL)
def id_prefix(spark, sf_dir):
    return ev(spark, sf_dir).filter(P.has_prefix(F.col("doc_id"), PREFIX)).select("event_id", "ts")


@query(f"SELECT event_id, ts FROM ev WHERE starts_with(doc_id, '{PREFIX}') AND ts > TIMESTAMP '{BOUND}'", EV_SQL)
def prefix_and_after(spark, sf_dir):
    both = P.has_prefix(F.col("doc_id"), PREFIX) & P.after(F.col("ts"), at(BOUND))
    return ev(spark, sf_dir).filter(both).select("event_id", "ts")


LAST_DOC = """
last AS (SELECT arg_max(doc_id, ts) AS doc_id FROM ev WHERE ts < TIMESTAMP '2024-01-10 00:00:00')"""


@query("SELECT event_id FROM ev WHERE doc_id <> (SELECT doc_id FROM last)", EV_SQL, LAST_DOC)
def exclude_last_doc(spark, sf_dir):
    events = ev(spark, sf_dir)
    last = events.filter(F.col("ts") < at(BOUND)).agg(F.max_by("doc_id", F.struct(*ORDER)).alias("id")).first().id
    return events.filter(P.other_than(F.col("doc_id"), last)).select("event_id")


@query(
    """SELECT consumer_id, event_id FROM ev JOIN off USING (consumer_id, index_name)
       WHERE last_id IS NULL OR ts > last_ts OR (ts = last_ts AND event_id > last_id)""",
    EV_SQL,
    OFF_SQL,
)
def first_run_or_resume(spark, sf_dir):
    events = ev(spark, sf_dir)
    slim = events.select(*OWNER, *ORDER)
    return pending_of_owner(slim, offsets(events), order=ORDER).select("consumer_id", "event_id")


@query("SELECT event_id FROM ev WHERE doc_id NOT IN (SELECT doc_id FROM led)", EV_SQL, LED_SQL)
def drop_seen_query(spark, sf_dir):
    events = ev(spark, sf_dir)
    return drop_seen(events, ledger(events)).select("event_id")


@query("SELECT event_id, upper(event_type) AS event_type, value * 2 AS value FROM events")
def process_events(spark, sf_dir):
    def hook(batch):
        return batch.select("event_id", F.upper("event_type").alias("event_type"), (F.col("value") * 2).alias("value"))

    return raw_events(spark, sf_dir).transform(hook)


@query(
    """SELECT event_id, 'Processing event: ' || doc_id || ' - Type: ' || event_type || ' - User: ' || user_id
              || ' - Data: ' || props AS line FROM ev""",
    EV_SQL,
)
def render_events(spark, sf_dir):
    line = text.event_line(F.col("doc_id"), F.col("event_type"), F.col("user_id"), F.col("props"))
    return ev(spark, sf_dir).select("event_id", line.alias("line"))


@query(f"SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT {K}")
def next_batch(spark, sf_dir):
    return fetch.next_batch(raw_events(spark, sf_dir).select("event_id", "ts"), K, ORDER)


@query(
    f"SELECT event_id, ts FROM ev WHERE starts_with(doc_id, '{PREFIX}') ORDER BY ts, event_id LIMIT {K}", EV_SQL
)
def fetch_first_run(spark, sf_dir):
    return fetch.fetch_first_run(ev(spark, sf_dir), PREFIX, K, ORDER).select("event_id", "ts")


@query(
    f"""SELECT event_id, ts FROM ev WHERE starts_with(doc_id, '{PREFIX}') AND ts > TIMESTAMP '{BOUND}'
        ORDER BY ts, event_id LIMIT {K}""",
    EV_SQL,
)
def fetch_resume(spark, sf_dir):
    return fetch.fetch_resume(ev(spark, sf_dir), BOUND, None, PREFIX, K, ORDER).select("event_id", "ts")


MIN_POSITION = """
pos AS (
  SELECT ts, event_id FROM mins WHERE ts < TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id LIMIT 1
)"""


@query(
    f"""SELECT m.event_id, m.ts FROM mins m, pos
        WHERE m.ts > pos.ts OR (m.ts = pos.ts AND m.event_id > pos.event_id)
        ORDER BY m.ts, m.event_id LIMIT {K}""",
    EV_SQL,
    MIN_POSITION,
)
def fetch_resume_keyset(spark, sf_dir):
    """Resume at the first event of the last minute before the bound: ties must not be lost."""
    events = by_minute(ev(spark, sf_dir))
    position = (
        events.filter(F.col("ts") < at(BOUND))
        .agg(F.max_by(F.struct(exact_text(F.col("ts"), T.TimestampNTZType()).alias("ts"), "event_id"), F.struct("ts", -F.col("event_id"))).alias("p"))
        .select("p.*")
        .first()
    )
    found = fetch.fetch_resume(events, position.ts, position.event_id, None, K, ORDER)
    return found.select("event_id", "ts")


@query(
    f"""SELECT event_id, ts FROM ev, (SELECT * FROM off WHERE consumer_id = 'c0' AND index_name = 'click') o
        WHERE ev.index_name = 'click' AND doc_id <> 'click_' || o.last_id
          AND ts > least(o.last_ts, coalesce(o.query_start, o.last_ts)) - INTERVAL 30 SECONDS
          AND doc_id NOT IN (SELECT doc_id FROM led)
        ORDER BY ts, event_id LIMIT {K}""",
    EV_SQL,
    OFF_SQL,
    LED_SQL,
)
def fetch_safety_window(spark, sf_dir):
    events = ev(spark, sf_dir)
    mine = offsets(events).filter("consumer_id = 'c0' AND index_name = 'click'")
    start = safe_start(F.col("query_start"), F.col("last_ts"))
    row = mine.select(exact_text(start, T.TimestampNTZType()).alias("start"), "last_id").first()
    clicks = events.filter(F.col("index_name") == "click")
    found = fetch.fetch_safety_window(clicks, ledger(events), row.start, f"click_{row.last_id}", K, order=ORDER)
    return found.select("event_id", "ts")


@query(f"SELECT event_id FROM events WHERE event_id > {AFTER_SEQ} ORDER BY event_id LIMIT {K}")
def fetch_after_seq(spark, sf_dir):
    return fetch.fetch_after_seq(raw_events(spark, sf_dir).select("event_id"), AFTER_SEQ, K, "event_id")


@query(
    f"""SELECT o.consumer_id, o.index_name, e.event_id,
               row_number() OVER (PARTITION BY o.consumer_id, o.index_name ORDER BY e.ts, e.event_id) AS rn
        FROM ev e JOIN off o ON e.index_name = o.index_name
             AND (o.last_ts IS NULL OR e.ts > o.last_ts OR (e.ts = o.last_ts AND e.event_id > o.last_id))
        QUALIFY rn <= {K}""",
    EV_SQL,
    OFF_SQL,
)
def pending_per_consumer(spark, sf_dir):
    events = ev(spark, sf_dir)
    shared = events.select("index_name", *ORDER)
    pending = fetch.pending_per_consumer(shared, offsets(events), K, ORDER)
    return pending.select("consumer_id", "index_name", "event_id", F.col("rn").cast("long").alias("rn"))


@query(
    """SELECT o.consumer_id, o.index_name, count(e.event_id) AS lag_n,
              greatest((epoch_us(any_value(t.newest)) - epoch_us(coalesce(any_value(o.last_ts), TIMESTAMP '1970-01-01'))) // 1000000, 0)
                AS lag_s
       FROM off o
       JOIN (SELECT index_name, max(ts) AS newest FROM ev GROUP BY 1) t ON t.index_name = o.index_name
       LEFT JOIN ev e ON e.index_name = o.index_name
            AND (o.last_ts IS NULL OR e.ts > o.last_ts OR (e.ts = o.last_ts AND e.event_id > o.last_id))
       GROUP BY 1, 2""",
    EV_SQL,
    OFF_SQL,
)
def offset_lag_query(spark, sf_dir):
    events = ev(spark, sf_dir)
    return offset_lag(events, offsets(events), ORDER)


