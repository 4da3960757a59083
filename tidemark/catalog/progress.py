"""Offset maintenance, commit cadence, reports, replays and failures."""

from pyspark.sql import functions as F

from tidemark.catalog.inputs import (
    AS_OF,
    BOUND,
    COMMITS_UNTIL,
    EV_SQL,
    LED_SQL,
    LOG_SQL,
    NEW_SQL,
    NTZ,
    OFF_SQL,
    ORDER,
    OWNER,
    SESSION_START,
    at,
    by_minute,
    ev,
    ledger,
    log,
    offsets,
    raw_events,
    resent,
)
from tidemark.catalog.registry import query
from tidemark.functions import timestamps as ts_fn
from tidemark.operators import cadence, failures, lateness, reports
from tidemark.operators import offsets as ops
from tidemark.operators.dedup import dedup_events as dedup
from tidemark.operators.dedup import drop_seen, processed_flag as flag
from tidemark.operators.upsert import ingest, newest_per_id, upsert, upsert_outcome as outcome
from tidemark.plans.workspace import fresh_path
from tidemark.sources.events import scan_events
from tidemark.sources.store import OffsetStore, append_commits
from tidemark.sources.tables import to_declared, upsert_into, write_by_day

# --- upserts

EXISTING = f"old AS (SELECT event_id, value FROM ev WHERE ts < TIMESTAMP '{BOUND}')"
INCOMING = """
incoming AS (
  SELECT event_id, value + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS value FROM resent
)"""


def _incoming(events):
    """The re-sent events; purchases come in two versions, of which the later has a higher value."""
    again = resent(events).select("event_id", "event_type", "value", F.lit(1).alias("version"))
    later = again.filter("event_type = 'purchase'").withColumn("value", F.col("value") + 1).withColumn("version", F.lit(2))
    return newest_per_id(again.unionByName(later), "version", "event_id").select("event_id", "value")


def _existing(events):
    return events.filter(F.col("ts") < at(BOUND)).select("event_id", "value")


@query(
    "SELECT * FROM incoming UNION ALL SELECT * FROM old WHERE event_id NOT IN (SELECT event_id FROM incoming)",
    EV_SQL,
    NEW_SQL,
    EXISTING,
    INCOMING,
)
def upsert_events(spark, sf_dir):
    events = ev(spark, sf_dir)
    return upsert(_existing(events), _incoming(events), "event_id")


@query(
    """SELECT CASE WHEN old.event_id IS NULL THEN 'created' ELSE 'updated' END AS outcome, count(*) AS n
       FROM incoming LEFT JOIN old USING (event_id) GROUP BY 1""",
    EV_SQL,
    NEW_SQL,
    EXISTING,
    INCOMING,
)
def upsert_outcome(spark, sf_dir):
    events = ev(spark, sf_dir)
    return outcome(_existing(events), _incoming(events), "event_id")


@query(
    f"""SELECT doc_id, ts, props || ' again' AS data FROM resent
        UNION ALL
        SELECT doc_id, ts, props AS data FROM ev
        WHERE ts < TIMESTAMP '{BOUND}' AND doc_id NOT IN (SELECT doc_id FROM resent)""",
    EV_SQL,
    NEW_SQL,
)
def upsert_table(spark, sf_dir):
    """The same on a stored table laid out by day; some re-sent events move to the next day."""
    events = ev(spark, sf_dir)
    path = fresh_path(spark, "events")

    def declared(rows, data):
        return to_declared(
            rows.select(
                "doc_id",
                F.col("event_id").alias("queryid"),
                F.col("ts").alias("timestamp"),
                "event_type",
                "user_id",
                data.alias("data"),
            )
        )

    write_by_day(declared(events.filter(F.col("ts") < at(BOUND)), F.col("props")), path)
    upsert_into(spark, path, declared(resent(events), F.concat("props", F.lit(" again"))))
    return scan_events(spark, path).select("doc_id", F.col("timestamp").cast(NTZ).alias("ts"), "data")


ISO_SQL = r"""regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', ''), '(\.\d{3})000$', '\1') || 'Z'"""


@query(
    f"""SELECT doc_id, ts, user_id::VARCHAR AS user_id,
               'Sample data for ' || event_type || ' event by ' || user_id || ' at ' || {ISO_SQL} AS data FROM ev""",
    EV_SQL,
)
def ingest_events(spark, sf_dir):
    raw = ev(spark, sf_dir).select("doc_id", F.col("ts").alias("timestamp"), "event_type", "user_id")
    return ingest(raw).select("doc_id", F.col("timestamp").cast(NTZ).alias("ts"), "user_id", "data")


# --- the commit log


@query(
    """SELECT consumer_id, index_name, commit_seq, count(*) AS n FROM log GROUP BY ALL""",
    EV_SQL,
    LOG_SQL,
)
def commit_log_append(spark, sf_dir):
    """Two append batches, the second written twice: the replay replaces itself."""
    commits = log(ev(spark, sf_dir))
    path = fresh_path(spark, "commit-log")
    earlier = commits.filter(F.col("last_ts") < at(BOUND))
    later = commits.filter(F.col("last_ts") >= at(BOUND))
    append_commits(earlier, path, 0)
    append_commits(later, path, 1)
    append_commits(later, path, 1)
    written = spark.read.schema(commits.schema).parquet(path)
    return written.groupBy(*OWNER, "commit_seq").agg(F.count(F.lit(1)).alias("n"))


WANTED_SQL = """
wanted AS (SELECT DISTINCT consumer_id, index_name FROM ev UNION SELECT DISTINCT 'c9', index_name FROM ev)"""


def _wanted(events):
    """Every consumer of every index, and one that has never been seen."""
    keys = events.select(*OWNER).distinct()
    return keys.union(keys.select(F.lit("c9"), "index_name").distinct())


@query(
    """SELECT consumer_id, index_name, coalesce(last_ts, TIMESTAMP '1970-01-01') AS last_ts, coalesce(total, 0) AS total
       FROM wanted LEFT JOIN latest USING (consumer_id, index_name)""",
    EV_SQL,
    LOG_SQL,
    WANTED_SQL,
)
def load_offsets(spark, sf_dir):
    events = ev(spark, sf_dir)
    loaded = ops.load_offsets(log(events), _wanted(events), "last_ts", "total")
    return loaded.select(*OWNER, "last_ts", "total")


@query("SELECT consumer_id, index_name FROM latest WHERE consumer_id <> 'c1'", EV_SQL, LOG_SQL)
def delete_offsets(spark, sf_dir):
    """What is left after c1's offsets are deleted, next to the tombstones already in the log."""
    commits = log(ev(spark, sf_dir))
    doomed = commits.select(*OWNER).filter("consumer_id = 'c1'")
    return ops.latest_offsets(ops.delete_offsets(commits, doomed)).select(*OWNER)


@query(
    """SELECT consumer_id, index_name, latest.commit_seq IS NOT NULL AS found
       FROM wanted LEFT JOIN latest USING (consumer_id, index_name)""",
    EV_SQL,
    LOG_SQL,
    WANTED_SQL,
)
def offset_exists(spark, sf_dir):
    events = ev(spark, sf_dir)
    return ops.offset_exists(log(events), _wanted(events))


@query(
    """SELECT consumer_id, index_name, max(ts) AS last_ts, arg_max(event_id, ts) AS last_event_id,
              count(*) FILTER (WHERE last_ts IS NULL OR ts > last_ts) + any_value(total) AS total
       FROM ev JOIN off USING (consumer_id, index_name) GROUP BY 1, 2""",
    EV_SQL,
    OFF_SQL,
)
def advance_offsets(spark, sf_dir):
    events = ev(spark, sf_dir)
    stored = offsets(events)
    pending = ops.pending_of_owner(events.select(*OWNER, *ORDER), stored, order=ORDER)
    moved = ops.advance_offsets(pending, stored, order=ORDER)
    return moved.withColumnRenamed("last_id", "last_event_id")


@query(
    """SELECT consumer_id, ts AS last_ts, event_id AS last_event_id FROM ev
       QUALIFY row_number() OVER (PARTITION BY consumer_id ORDER BY value DESC, event_id DESC) = 1""",
    EV_SQL,
)
def last_handled(spark, sf_dir):
    """Events handled in the order of their value: the position may go back in time."""
    events = ev(spark, sf_dir).select("consumer_id", *ORDER, "value")
    return ops.last_handled(events, ["value", "event_id"], order=ORDER).withColumnRenamed("last_id", "last_event_id")


@query(
    """SELECT consumer_id, epoch_us(ts) // 1000 AS last_ts_ms FROM ev
       QUALIFY row_number() OVER (PARTITION BY consumer_id ORDER BY value DESC, event_id DESC) = 1""",
    EV_SQL,
)
def update_from_display_ts(spark, sf_dir):
    events = ev(spark, sf_dir).select("consumer_id", "event_id", "value", ts_fn.display_text(F.col("ts")).alias("shown"))
    moved = ops.last_handled_display(events, "shown", ["value", "event_id"], order=ORDER)
    return moved.select("consumer_id", F.unix_millis("last_ts").alias("last_ts_ms"))


@query(
    """SELECT coalesce(l.consumer_id, d.consumer_id) AS consumer_id, coalesce(l.index_name, d.index_name) AS index_name,
              coalesce(l.total, 0) + coalesce(d.n, 0) AS total
       FROM latest l FULL JOIN (SELECT consumer_id, index_name, count(*) AS n FROM led GROUP BY 1, 2) d
            ON l.consumer_id = d.consumer_id AND l.index_name = d.index_name""",
    EV_SQL,
    LOG_SQL,
    LED_SQL,
)
def increment_totals(spark, sf_dir):
    events = ev(spark, sf_dir)
    return ops.increment_totals(ops.latest_offsets(log(events)), ledger(events))


# --- commit cadence

RANKED = """
ranked AS (
  SELECT consumer_id, event_id, row_number() OVER (PARTITION BY consumer_id ORDER BY ts, event_id) AS rn,
         count(*) OVER (PARTITION BY consumer_id) AS n
  FROM ev
)"""


def _owned(spark, sf_dir):
    return ev(spark, sf_dir).select("consumer_id", *ORDER)


@query("SELECT consumer_id, event_id, rn // 100 AS commit_no FROM ranked WHERE rn % 100 = 0", EV_SQL, RANKED)
def commit_points_count(spark, sf_dir):
    points = cadence.commit_points_count(_owned(spark, sf_dir), 100, order=ORDER)
    return points.select("consumer_id", "event_id", "commit_no")


@query(
    "SELECT consumer_id, event_id, (rn + 99) // 100 AS commit_no FROM ranked WHERE rn % 100 = 0 OR rn = n",
    EV_SQL,
    RANKED,
)
def commit_points_final(spark, sf_dir):
    points = cadence.commit_points_final(_owned(spark, sf_dir), 100, order=ORDER)
    return points.select("consumer_id", "event_id", "commit_no")


@query("SELECT consumer_id, rn, event_id FROM ranked WHERE rn % 50 = 0", EV_SQL, RANKED)
def progress_marks(spark, sf_dir):
    return cadence.every_nth(_owned(spark, sf_dir), cadence.REPORT_EVERY, order=ORDER).select("consumer_id", "rn", "event_id")


CHAIN = """
timed AS (
  SELECT consumer_id, event_id, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY consumer_id ORDER BY ts, event_id) AS rn
  FROM ev
),
walk AS (
  SELECT consumer_id, event_id, rn, us, us AS since, 1::BIGINT AS n, false AS hit FROM timed WHERE rn = 1
  UNION ALL
  SELECT t.consumer_id, t.event_id, t.rn, t.us, CASE WHEN w.hit THEN w.us ELSE w.since END,
         CASE WHEN w.hit THEN 1 ELSE w.n + 1 END,
         (CASE WHEN w.hit THEN 1 ELSE w.n + 1 END) >= 100
           OR t.us - (CASE WHEN w.hit THEN w.us ELSE w.since END) >= 100000::BIGINT * 1000000
  FROM walk w JOIN timed t ON t.consumer_id = w.consumer_id AND t.rn = w.rn + 1
)"""


@query(
    """SELECT consumer_id, event_id, n FROM walk WHERE n > 0 AND hit""",
    EV_SQL,
    CHAIN,
)
def commit_points_count_or_time(spark, sf_dir):
    points = cadence.commit_points_count_or_time(_owned(spark, sf_dir), 100, 100_000, order=ORDER)
    return points.select("consumer_id", "event_id", "n")


# --- reports


@query(
    f"""SELECT consumer_id, count(*) FILTER (WHERE commit_seq >= {SESSION_START}) AS session_n, count(*) AS total_n
        FROM led GROUP BY 1""",
    EV_SQL,
    LED_SQL,
)
def session_totals(spark, sf_dir):
    return reports.session_totals(ledger(ev(spark, sf_dir)), SESSION_START)


@query(
    f"""SELECT l.consumer_id, l.index_name, l.last_ts, l.total, coalesce(s.n, 0) AS session_n
        FROM latest l LEFT JOIN (SELECT consumer_id, index_name, count(*) AS n FROM led
                                 WHERE commit_seq >= {SESSION_START} GROUP BY 1, 2) s
             USING (consumer_id, index_name)""",
    EV_SQL,
    LOG_SQL,
    LED_SQL,
)
def consumer_status(spark, sf_dir):
    events = ev(spark, sf_dir)
    status = reports.consumer_status(log(events), ledger(events), SESSION_START)
    return status.select(*OWNER, "last_ts", "total", "session_n")


@query(
    f"""SELECT c.consumer_id, c.index_name, count(d.doc_id) AS uncommitted,
               epoch_us(TIMESTAMP '{AS_OF}') // 1000 - epoch_us(any_value(c.last_ts)) // 1000 AS ms_since
        FROM (SELECT * FROM (SELECT * FROM log WHERE last_ts < TIMESTAMP '{COMMITS_UNTIL}'
              QUALIFY row_number() OVER (PARTITION BY consumer_id, index_name ORDER BY commit_seq DESC) = 1)
              WHERE NOT deleted) c
        LEFT JOIN led d ON d.consumer_id = c.consumer_id AND d.index_name = c.index_name AND d.commit_seq > c.commit_seq
        GROUP BY 1, 2""",
    EV_SQL,
    LOG_SQL,
    LED_SQL,
)
def commit_backlog(spark, sf_dir):
    events = ev(spark, sf_dir)
    committed = log(events).filter(F.col("last_ts") < at(COMMITS_UNTIL))
    return reports.commit_backlog(committed, ledger(events), AS_OF)


@query(
    """SELECT consumer_id, index_name, count(*) AS commits,
              CASE WHEN count(*) > 1 THEN
                (arg_max(epoch_us(last_ts), commit_seq) - arg_min(epoch_us(last_ts), commit_seq))
                  / (count(*) - 1) / 1000000::DOUBLE END AS avg_gap_s
       FROM log GROUP BY 1, 2""",
    EV_SQL,
    LOG_SQL,
)
def commit_frequency(spark, sf_dir):
    return reports.commit_frequency(log(ev(spark, sf_dir)), "last_ts")


# --- starts, late events, attempts, replays, failures


@query(
    "SELECT consumer_id, index_name, commit_seq, last_ts - INTERVAL 30 SECONDS AS start_ts FROM log", EV_SQL, LOG_SQL
)
def safety_start(spark, sf_dir):
    return log(ev(spark, sf_dir)).select(*OWNER, "commit_seq", ts_fn.back_off(F.col("last_ts")).alias("start_ts"))


@query(
    """SELECT consumer_id, index_name, commit_seq, coalesce(query_start, last_ts) AS start_ts,
              least(last_ts, coalesce(query_start, last_ts)) AS safe_ts FROM log""",
    EV_SQL,
    LOG_SQL,
)
def effective_start(spark, sf_dir):
    begun, last = F.col("query_start"), F.col("last_ts")
    return log(ev(spark, sf_dir)).select(
        *OWNER,
        "commit_seq",
        ts_fn.effective_start(begun, last).alias("start_ts"),
        ts_fn.safe_start(begun, last).alias("safe_ts"),
    )


@query(
    "SELECT commit_seq, strftime(coalesce(query_start, last_ts), '%b %-d, %Y @ %H:%M:%S.%g') AS start_text FROM log",
    EV_SQL,
    LOG_SQL,
)
def effective_start_display(spark, sf_dir):
    start = ts_fn.effective_start(F.col("query_start"), F.col("last_ts"))
    return log(ev(spark, sf_dir)).select("commit_seq", ts_fn.display_text(start).alias("start_text"))


@query(
    """SELECT event_id, epoch_us(high) - epoch_us(ts) AS lag_us FROM (
         SELECT event_id, ts, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
         FROM (SELECT event_id, ts - to_seconds(user_id * 10) AS ts FROM events))
       WHERE epoch_us(high) - epoch_us(ts) > 0 AND epoch_us(high) - epoch_us(ts) < 30000000""",
)
def late_within_window(spark, sf_dir):
    """Events arrive in id order, delayed by ten seconds times their user number, in one index."""
    arrivals = raw_events(spark, sf_dir).select(
        F.lit("events").alias("index_name"),
        "event_id",
        (F.col("ts") - F.make_dt_interval(secs=F.col("user_id") * 10)).alias("ts"),
    )
    return lateness.late_within_window(arrivals, ["event_id"], "ts").select("event_id", "lag_us")


@query("SELECT consumer_id, index_name, commit_seq FROM log WHERE deleted", EV_SQL, LOG_SQL)
def open_attempts(spark, sf_dir):
    """Every commit was begun; those that ended in a tombstone were never finished."""
    starts = log(ev(spark, sf_dir))
    return ops.open_attempts(starts, starts.filter(~F.col("deleted")), [*OWNER, "commit_seq"]).select(*OWNER, "commit_seq")


@query(
    """SELECT event_id, ts FROM (SELECT * FROM ev UNION ALL SELECT * FROM resent)
       QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) = 1""",
    EV_SQL,
    NEW_SQL,
)
def dedup_events(spark, sf_dir):
    events = ev(spark, sf_dir)
    arrived = events.unionByName(resent(events)).select("doc_id", *ORDER)
    return dedup(arrived, order=ORDER).select("event_id", "ts")


def _two_epochs(events):
    """Handled before the seek, and the part handled again since."""
    return ledger(events).unionByName(ledger(events, 100.0, 1))


@query(f"SELECT event_id FROM ev WHERE ts > TIMESTAMP '{BOUND}' AND value < 100", EV_SQL)
def seek_replay(spark, sf_dir):
    events = ev(spark, sf_dir)
    return ops.replay(events, _two_epochs(events), BOUND, 1, order=ORDER).select("event_id")


@query("SELECT event_id FROM ev WHERE value < 100", EV_SQL)
def reset_replay(spark, sf_dir):
    events = ev(spark, sf_dir)
    return ops.replay(events, _two_epochs(events), None, 1, order=ORDER).select("event_id")


@query("SELECT event_id, 1::BIGINT AS times FROM events")
def resume_no_gap_no_dup(spark, sf_dir):
    """Two runs with a stop between equal times; the second starts from the stored offset."""
    from tidemark.consumer import Consumer

    events = by_minute(ev(spark, sf_dir))
    documents = events.select(F.lpad(F.col("event_id").cast("string"), 19, "0").alias("doc_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    store = OffsetStore(spark, fresh_path(spark, "store"))
    # the first run meets the table as it was: up to the first event of a minute in mid-month
    stop = documents.filter(F.col("timestamp") >= ts_fn.as_bound("2024-01-15 12:00:00"))
    stop = stop.agg(F.min(F.struct("timestamp", "doc_id")).alias("p"))
    stop = stop.select(ts_fn.micros(F.col("p.timestamp")).alias("us"), "p.doc_id").first()
    edge = ts_fn.as_bound(stop.us)
    early = documents.filter(
        (F.col("timestamp") < edge) | ((F.col("timestamp") == edge) & (F.col("doc_id") <= stop.doc_id))
    )
    runs = []
    for present in (early, documents):
        consumer = Consumer(store, lambda: present, "c0", "events", batch_size=None, safety_seconds=None)
        runs.append(consumer.consume().events)
    return (
        runs[0]
        .unionByName(runs[1])
        .groupBy(F.col("doc_id").cast("long").alias("event_id"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


@query(
    """SELECT consumer_id, event_id FROM ev
       LEFT JOIN (SELECT consumer_id, min(ts) AS stop FROM ev WHERE value > 300 GROUP BY 1) USING (consumer_id)
       WHERE stop IS NULL OR ts < stop""",
    EV_SQL,
)
def prefix_before_failure(spark, sf_dir):
    """Events of very high value fail."""
    events = ev(spark, sf_dir).select("consumer_id", *ORDER, "value")
    done = failures.prefix_before_failure(events, F.col("value") <= 300, order=ORDER)
    return done.select("consumer_id", "event_id")


# --- flags over the whole history


@query(
    "SELECT event_id, doc_id IN (SELECT doc_id FROM led) AS processed FROM ev",
    EV_SQL,
    LED_SQL,
)
def processed_flag(spark, sf_dir):
    events = ev(spark, sf_dir)
    return flag(events, ledger(events)).select("event_id", "processed")


@query(
    "SELECT event_id FROM resent WHERE doc_id NOT IN (SELECT doc_id FROM led)",
    EV_SQL,
    LED_SQL,
    NEW_SQL,
)
def drop_all_seen(spark, sf_dir):
    """Re-sent events against everything ever handled, by whichever consumer."""
    events = ev(spark, sf_dir)
    return drop_seen(resent(events), ledger(events), ["doc_id"]).select("event_id")


# --- rows that lack a key or a time

_KEYLESS = "CASE WHEN event_type <> 'error' THEN event_type END"


@query(
    f"""SELECT k, event_id, rn // 100 AS commit_no FROM (
          SELECT {_KEYLESS} AS k, event_id, row_number() OVER (PARTITION BY {_KEYLESS} ORDER BY ts, event_id) AS rn FROM events)
        WHERE rn % 100 = 0"""
)
def commit_points_null_key(spark, sf_dir):
    """Events without a key form a group of their own."""
    key = F.when(F.col("event_type") != "error", F.col("event_type")).alias("k")
    keyed = raw_events(spark, sf_dir).select(key, *ORDER)
    return cadence.commit_points_count(keyed, 100, ("k",), ORDER).select("k", "event_id", "commit_no")


@query(
    """SELECT doc_id, CASE WHEN event_type = 'purchase' OR value >= 10 THEN ts END AS ts,
              CASE WHEN event_type = 'purchase' THEN props || ' again' ELSE props END AS data FROM ev""",
    EV_SQL,
)
def upsert_null_time(spark, sf_dir):
    """A stored table in which some events have no time; purchases come again, now with one."""
    events, path = ev(spark, sf_dir), fresh_path(spark, "undated")

    def declared(rows, ts, data):
        return to_declared(rows.select("doc_id", F.col("event_id").alias("queryid"), ts.alias("timestamp"), "event_type", "user_id", data.alias("data")))

    write_by_day(declared(events, F.when(F.col("value") >= 10, F.col("ts")), F.col("props")), path)
    upsert_into(spark, path, declared(events.filter("event_type = 'purchase'"), F.col("ts"), F.concat("props", F.lit(" again"))))
    return scan_events(spark, path).select("doc_id", F.col("timestamp").cast(NTZ).alias("ts"), "data")


# --- one store, several writers


def _documents(spark, sf_dir):
    padded = F.lpad(F.col("event_id").cast("string"), 19, "0").alias("doc_id")
    return raw_events(spark, sf_dir).select(padded, F.col("ts").cast("timestamp").alias("timestamp"))


WEEKS = ("2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00")


@query(
    "SELECT event_id, ("
    + " + ".join(f"(ts >= TIMESTAMP '{w}')::BIGINT" for w in WEEKS)
    + ")::BIGINT AS commit_seq FROM events WHERE ts IS NOT NULL"
)
def compacted_log(spark, sf_dir):
    """Four weekly runs, compacted after each: every event keeps the number of its commit."""
    from tidemark.consumer import Consumer

    documents, store = _documents(spark, sf_dir), OffsetStore(spark, fresh_path(spark, "compacted"))
    for until in (*WEEKS, None):
        present = documents if until is None else documents.filter(F.col("timestamp") < ts_fn.as_bound(until))
        Consumer(store, lambda: present, "c0", "events", batch_size=None, safety_seconds=None).consume()
        store.compact("c0", "events")
    return store.ledger().select(F.col("doc_id").cast("long").alias("event_id"), F.col("commit_seq").cast("long").alias("commit_seq"))


@query("SELECT event_id, 1::BIGINT AS times FROM events WHERE ts IS NOT NULL")
def resume_batch_then_stream(spark, sf_dir):
    """The first half of the month by the batch consumer, the rest by a stream on the same store."""
    from tidemark.consumer import Consumer
    from tidemark.sources.events import stream_events
    from tidemark.streaming.pipeline import EventPipeline

    root, documents = fresh_path(spark, "modes"), _documents(spark, sf_dir)
    documents.repartitionByRange("timestamp").write.parquet(f"{root}/in")
    store = OffsetStore(spark, f"{root}/store")
    early = documents.filter(F.col("timestamp") < ts_fn.as_bound(WEEKS[1]))
    Consumer(store, lambda: early, "c0", "events", batch_size=None, sink=f"{root}/batches").consume()
    pipeline = EventPipeline(store, "c0", "events", f"{root}/sink", f"{root}/checkpoint", skip_handled=True)
    pipeline.run(lambda: stream_events(spark, f"{root}/in", documents.schema, files_per_batch=4))
    written = [spark.read.schema(documents.schema).parquet(f"{root}/{part}").select("doc_id") for part in ("batches", "sink")]
    return (
        written[0].unionByName(written[1]).groupBy(F.col("doc_id").cast("long").alias("event_id")).agg(F.count(F.lit(1)).alias("times"))
    )


@query(
    """SELECT consumer_id, index_name, count(*) AS gaps, max(gap) AS longest_us, true AS median_holds, true AS tail_holds
       FROM (SELECT consumer_id, index_name,
                    epoch_us(last_ts) - lag(epoch_us(last_ts)) OVER (PARTITION BY consumer_id, index_name ORDER BY last_ts, commit_seq) AS gap
             FROM log)
       WHERE gap IS NOT NULL GROUP BY 1, 2""",
    EV_SQL,
    LOG_SQL,
)
def commit_gap_quantiles(spark, sf_dir):
    """Sketches of two halves of the log, merged: the median and the 95th percentile lie where the exact ranks say, within
    the error that the sketch states."""
    commits = log(ev(spark, sf_dir))
    cut = at(COMMITS_UNTIL)
    # The later half begins with each key's last commit of the earlier one.
    last = commits.filter(F.col("last_ts") < cut).groupBy(*OWNER).agg(F.max_by(F.struct("last_ts", "commit_seq"), F.struct("last_ts", "commit_seq")).alias("x"))
    halves = (
        commits.filter(F.col("last_ts") < cut).select(*OWNER, "last_ts", "commit_seq"),
        commits.filter(F.col("last_ts") >= cut).select(*OWNER, "last_ts", "commit_seq").unionByName(last.select(*OWNER, "x.*")),
    )
    parts = [reports.gap_sketches(half, "last_ts") for half in halves]
    merged = reports.merged_gap_sketches(parts[0].unionByName(parts[1]))
    told = merged.withColumns({"median": reports.gap_quantile(0.5), "tail": reports.gap_quantile(0.95)}).drop("sketch")
    gaps = reports.commit_gaps(commits, "last_ts").join(told, list(OWNER))
    below = lambda c: F.avg((F.col("gap_us") < F.col(c)).cast("double"))
    upto = lambda c: F.avg((F.col("gap_us") <= F.col(c)).cast("double"))
    holds = lambda c, q: (below(c) <= q + reports.GAP_RANK_ERROR) & (upto(c) >= q - reports.GAP_RANK_ERROR)
    return gaps.groupBy(*OWNER).agg(
        F.max("gaps").alias("gaps"), F.max("longest_us").alias("longest_us"), holds("median", 0.5).alias("median_holds"), holds("tail", 0.95).alias("tail_holds")
    )

