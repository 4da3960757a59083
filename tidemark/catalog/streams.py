"""Streaming queries: run to the end of the given table, then read the sink back."""

from pyspark.sql import functions as F

from tidemark.catalog.inputs import BOUND, EV_SQL, NEW_SQL, RAW, at, ev, ledger, raw_events, resent
from tidemark.catalog.progress import CHAIN
from tidemark.catalog.registry import query
from tidemark.consumer import Consumer
from tidemark.operators.dedup import drop_seen
from tidemark.plans.workspace import fresh_path
from tidemark.sources.events import decode_or_set_aside, stream_events
from tidemark.sources.sequence import Sequence, numbered
from tidemark.sources.store import OffsetStore
from tidemark.sources.tables import load_events
from tidemark.streaming.cadence import commit_points
from tidemark.streaming.pipeline import EventPipeline, dedup_stream


def _to_files(stream, spark, label):
    """Run a stream into a parquet sink and read the sink."""
    out = fresh_path(spark, label)
    run = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", fresh_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_id, ts, user_id, event_type, props FROM events")
def stream_scan_events(spark, sf_dir):
    raw_events(spark, sf_dir)
    stream = stream_events(spark, sf_dir, RAW, pathGlobFilter="events.parquet")
    return _to_files(stream.select("event_id", "ts", "user_id", "event_type", "props"), spark, "stream-scan")


def _declared(events):
    """Stream columns: a zoned time, which watermarks need."""
    return events.select("event_id", "doc_id", F.col("ts").cast("timestamp").alias("timestamp"))


@query("SELECT event_id FROM events")
def stream_dedup_events(spark, sf_dir):
    """The table as several files, followed by files of re-sent copies."""
    folder = fresh_path(spark, "dedup-source")
    events = ev(spark, sf_dir)
    first, again = _declared(events), _declared(resent(events))
    first.repartitionByRange("timestamp").write.parquet(folder)
    again.repartitionByRange("timestamp").write.mode("append").parquet(folder)
    stream = stream_events(spark, folder, first.schema, files_per_batch=8)
    return _to_files(dedup_stream(stream, "60 days").select("event_id"), spark, "stream-dedup")


class _FailsOnce(EventPipeline):
    """Fails once, after the sink of its second batch is written."""

    failed = False

    def after_sink(self, batch_id):
        if batch_id == 1 and not self.failed:
            self.failed = True
            raise RuntimeError("injected after the sink write")


@query("SELECT event_id, 1::BIGINT AS times FROM events")
def stream_exactly_once(spark, sf_dir):
    """A batch that is written to the sink, fails before its commit and is replayed."""
    folder, root = fresh_path(spark, "once-source"), fresh_path(spark, "once")
    events = _declared(ev(spark, sf_dir))
    events.repartitionByRange("timestamp").write.parquet(folder)
    pipeline = _FailsOnce(OffsetStore(spark, f"{root}/store"), "c0", "events", f"{root}/sink", f"{root}/checkpoint")
    pipeline.run(lambda: stream_events(spark, folder, events.schema, files_per_batch=1), wait=0)
    written = spark.read.schema(events.schema).parquet(f"{root}/sink")
    return written.groupBy("event_id").agg(F.count(F.lit(1)).alias("times"))


# Where the table is cut into pieces that arrive one after the other.
ARRIVALS = ("2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-24 00:00:00")


@query("SELECT consumer_id, event_id, n FROM walk WHERE n > 0 AND hit", EV_SQL, CHAIN)
def stream_commit_points(spark, sf_dir):
    """Commits by count or time of a stream that is stopped and started again after each arrival; the last
    arrival is one event far ahead, so that all others are final."""
    folder, checkpoint, out = (fresh_path(spark, f"cadence-{x}") for x in ("source", "checkpoint", "points"))
    events = ev(spark, sf_dir)
    rows = events.select("consumer_id", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("doc_id"), F.col("ts").cast("timestamp").alias("timestamp"), "ts")
    late = events.agg(F.max("ts").alias("ts")).select(
        F.lit("end").alias("consumer_id"), F.lit("end").alias("doc_id"), (F.col("ts") + F.expr("INTERVAL 100 DAYS")).cast("timestamp").alias("timestamp")
    )
    bounds = [None, *map(at, ARRIVALS), None]
    pieces = [
        rows.filter((F.lit(True) if lo is None else F.col("ts") >= lo) & (F.lit(True) if hi is None else F.col("ts") < hi)).drop("ts")
        for lo, hi in zip(bounds, bounds[1:], strict=False)
    ]
    for piece in [*pieces, late]:
        piece.write.mode("append").parquet(folder)
        points = commit_points(stream_events(spark, folder, late.schema), 100, 100_000, ("consumer_id",), delay="1 second")
        run = points.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        run.start().awaitTermination()
    found = spark.read.schema(points.schema).parquet(out).filter("reason != 'idle' AND consumer_id != 'end'")
    return found.select("consumer_id", F.col("doc_id").cast("long").alias("event_id"), "n")


@query("SELECT event_id, 1::BIGINT AS times FROM events")
def two_writers(spark, sf_dir):
    """Two processes of one consumer poll from the same position, one a thousand events, one all of them."""
    root, events = fresh_path(spark, "writers"), _declared(ev(spark, sf_dir))
    few, all_ = (
        Consumer(OffsetStore(spark, f"{root}/store"), lambda: events, "c0", "events", batch_size=n, sink=f"{root}/sink") for n in (1000, None)
    )
    batches = few.consume(commit=False), all_.consume(commit=False)
    few.commit(batches[0])
    all_.commit(batches[1])
    written = spark.read.schema(events.schema).parquet(f"{root}/sink")
    return written.groupBy("event_id").agg(F.count(F.lit(1)).alias("times"))


@query(f"SELECT event_id, CASE WHEN ts > TIMESTAMP '{BOUND}' THEN 2 ELSE 1 END::BIGINT AS times FROM events")
def seek_while_streaming(spark, sf_dir):
    """A stream that polls is sent back once it has handled everything, and delivers what is later again."""
    folder, root = fresh_path(spark, "seek-source"), fresh_path(spark, "seek")
    events = _declared(ev(spark, sf_dir))
    events.write.parquet(folder)
    store = OffsetStore(spark, f"{root}/store")
    pipeline = EventPipeline(store, "c0", "events", f"{root}/sink", f"{root}/checkpoint")
    there = events.count()
    again = there + events.filter(F.col("timestamp") > at(BOUND).cast("timestamp")).count()

    def finished():
        now = store.load("c0", "events")
        if now.epoch == 0 and now.total == there:
            store.seek("c0", "events", BOUND)
        return now.total == again

    pipeline.follow(lambda: stream_events(spark, folder, events.schema), 0.2, finished)
    written = spark.read.schema(events.schema).parquet(f"{root}/sink")
    return written.groupBy("event_id").agg(F.count(F.lit(1)).alias("times"))


@query(
    "SELECT event_id, value FROM (SELECT * FROM ev UNION ALL SELECT * FROM resent) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) = 1",
    EV_SQL,
    NEW_SQL,
)
def load_repeated_ids(spark, sf_dir):
    """One load that holds many ids twice, loaded two times."""
    path = fresh_path(spark, "loaded")
    events = ev(spark, sf_dir)
    rows = [x.select("doc_id", F.col("ts").cast("timestamp").alias("timestamp"), "event_id", "value") for x in (events, resent(events))]
    for _ in range(2):
        load_events(spark, path, rows[0].unionByName(rows[1]))
    return spark.read.schema(rows[0].schema).parquet(path).select("event_id", "value")


# Rows of one delivery of the bounded stream.
DELIVERY = 2500


@query(
    f"""SELECT ((rn - 1) // {DELIVERY})::BIGINT AS delivery, event_id
        FROM (SELECT event_id, row_number() OVER (ORDER BY ts, doc_id) AS rn FROM ev)""",
    EV_SQL,
)
def stream_row_batches(spark, sf_dir):
    """A stream that delivers and commits so many rows at a time, in order, and fails once in between."""

    class FailsInside(EventPipeline):
        parts = 0

        def after_sink(self, batch_id):
            self.parts += 1
            if self.parts == 2:
                raise RuntimeError("injected in the second delivery")

    folder, root = fresh_path(spark, "rows-source"), fresh_path(spark, "rows")
    events = _declared(ev(spark, sf_dir))
    events.write.parquet(folder)
    pipeline = FailsInside(OffsetStore(spark, f"{root}/store"), "c0", "events", f"{root}/sink", f"{root}/checkpoint", batch_rows=DELIVERY)
    pipeline.run(lambda: stream_events(spark, folder, events.schema), wait=0)
    return spark.read.parquet(f"{root}/sink").select(F.col("batch_id").cast("long").alias("delivery"), "event_id")


@query(f"SELECT event_id FROM ev WHERE value < 10 AND ts >= TIMESTAMP '{BOUND}'", EV_SQL)
def drop_seen_bucketed(spark, sf_dir):
    """Events of the later days that a compacted ledger does not hold; only buckets that they can be in are read."""
    store = OffsetStore(spark, fresh_path(spark, "bucketed"), bucket_rows=2000)
    events = ev(spark, sf_dir)
    handled = ledger(events).withColumn("timestamp", F.col("ts").cast("timestamp"))
    for number, part in enumerate((handled.filter(F.col("ts") < at(BOUND)), handled.filter(F.col("ts") >= at(BOUND)))):
        store.record_handled("c0", "events", number, part)
        store.increment("c0", "events", 1)
    store.compact("c0", "events")
    batch = events.filter(F.col("ts") >= at(BOUND))
    return drop_seen(batch, store.handled_by("c0", "events", batch), ["doc_id"]).select("event_id")


@query(
    f"""SELECT event_id, (row_number() OVER (ORDER BY ts >= TIMESTAMP '{BOUND}', ts, doc_id) - 1)::BIGINT AS seq FROM ev""",
    EV_SQL,
)
def sequence_numbers(spark, sf_dir):
    """Two loads number their events one after the other; the first is repeated under its token."""
    sequence, events = Sequence(spark, fresh_path(spark, "sequence")), ev(spark, sf_dir)
    first, second = events.filter(F.col("ts") < at(BOUND)), events.filter(F.col("ts") >= at(BOUND))
    for _ in range(2):
        one = numbered(first, sequence, "first", ("ts", "doc_id"))
    two = numbered(second, sequence, "second", ("ts", "doc_id"))
    return one.unionByName(two).select("event_id", "seq")


@query(
    """SELECT CASE WHEN value < 10 THEN 'malformed body' WHEN value < 20 THEN 'no value of a required field'
                   WHEN value < 30 THEN 'field not of its type: timestamp' END AS reason, count(*)::BIGINT AS n,
              (sum(CASE WHEN value >= 30 THEN user_id END))::BIGINT AS unknown_sum
       FROM ev GROUP BY 1""",
    EV_SQL,
)
def set_aside_documents(spark, sf_dir):
    """Bodies cut short, without an id, with a time that is none, and whole ones with a field that no schema names."""
    value, field = F.col("value"), lambda name, v: F.concat(F.lit(f'"{name}":"'), v, F.lit('"'))
    doc_id, user = field("doc_id", F.col("doc_id")), field("shard", F.col("user_id").cast("string"))
    good = field("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    body = (
        F.when(value < 10, F.concat(F.lit("{"), doc_id))
        .when(value < 20, F.concat(F.lit("{"), user, F.lit("}")))
        .when(value < 30, F.concat(F.lit("{"), doc_id, F.lit(","), field("timestamp", F.lit("soon")), F.lit("}")))
        .otherwise(F.concat_ws(",", F.concat(F.lit("{"), doc_id), good, F.concat(user, F.lit("}"))))
    )
    accepted, aside = decode_or_set_aside(ev(spark, sf_dir).select("event_id", body.alias("body")))
    kept = accepted.select(F.lit(None).cast("string").alias("reason"), F.col("unknown")["shard"].cast("long").alias("shard"))
    both = kept.unionByName(aside.select("reason", F.lit(None).cast("long").alias("shard")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("shard").alias("unknown_sum"))
