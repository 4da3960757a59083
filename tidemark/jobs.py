"""Jobs to submit: ``spark-submit --py-files tidemark.zip tidemark/jobs.py consume --events ... --store ...``

The zip holds the package (``zip -r tidemark.zip tidemark``): tasks of the commit cadence import it.
"""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.consumer import Consumer  # noqa: E402
from tidemark.operators.upsert import ingest  # noqa: E402
from tidemark.plans.workspace import discard_scratch  # noqa: E402
from tidemark.sources.events import scan_if_present, stream_events  # noqa: E402
from tidemark.sources.store import OffsetStore  # noqa: E402
from tidemark.sources.tables import create_if_absent, load_events  # noqa: E402
from tidemark.streaming.pipeline import POLL_SECONDS, EventPipeline  # noqa: E402

# Fixed value: the index read and written unless told otherwise.
DEFAULT_INDEX = "events"
FILES_PER_BATCH = 1000
# What a sender may give; the rest is filled in.
RAW_EVENTS = "doc_id string, queryid string, timestamp string, event_type string, user_id string, data string"


def consume(spark, args):
    """Work off what is pending in batches, then print the status."""
    store = OffsetStore(spark, args.store)
    options = {"sink": args.sink, "batch_size": args.batch_size or None}
    read = lambda: scan_if_present(spark, args.events)
    if args.prefix:
        consumer = Consumer.read_only(store, read, args.index, args.consumer, args.prefix, **options)
    else:
        consumer = Consumer(store, read, args.consumer, args.index, **options)
    if args.seek:
        consumer.seek(args.seek)
    consumer.drain()
    store.compact(consumer.consumer_id, args.index)
    consumer.status().show(truncate=False)


def stream(spark, args):
    """The same as a stream: to the end of what is there, or on and on with --follow."""
    create_if_absent(spark, args.events)
    store = OffsetStore(spark, args.store)
    pipeline = EventPipeline(
        store, args.consumer, args.index, args.sink, f"{args.store}/checkpoint/{args.consumer}", prefix=args.prefix,
        dedup_delay=args.dedup_delay, skip_handled=not args.dedup_delay,  # an upsert rewrites files of its day
        batch_rows=args.batch_rows or None,
    )
    if args.follow:
        pipeline.follow(lambda: stream_events(spark, args.events, files_per_batch=args.files_per_batch), POLL_SECONDS)
    else:
        pipeline.run(lambda: stream_events(spark, args.events, files_per_batch=args.files_per_batch))
    store.compact(args.consumer, args.index)


def load(spark, args):
    """Ingest raw JSON or parquet rows into the event table."""
    # JSON gets a schema, so that it is read once; parquet brings its own.
    reader = spark.read.format(args.format)
    raw = (reader.schema(RAW_EVENTS) if args.format == "json" else reader).load(args.raw)
    load_events(spark, args.events, ingest(raw))


def status(spark, args):
    """The offset record of every consumer, and the size of the offset table."""
    store = OffsetStore(spark, args.store)
    store.latest().orderBy("consumer_id", "index_name").show(truncate=False)
    store.stats().show()


def parser():
    top = argparse.ArgumentParser(description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    for name, fn in (("consume", consume), ("stream", stream), ("load", load), ("status", status)):
        job = jobs.add_parser(name, help=fn.__doc__)
        job.set_defaults(run=fn)
        if name != "status":
            job.add_argument("--events", required=True, help="path of the event table")
        if name != "load":
            job.add_argument("--store", required=True, help="path of the offset store")
        if name in ("consume", "stream"):
            job.add_argument("--index", default=DEFAULT_INDEX)
            job.add_argument("--consumer", required=name == "stream")
            job.add_argument("--prefix", help="handle only ids with this prefix, strictly in order")
            job.add_argument("--sink", required=name == "stream")
    jobs.choices["consume"].add_argument("--batch-size", type=int, default=0, help="0: all that is pending, as one distributed batch")
    jobs.choices["consume"].add_argument("--seek", help="first move to this UTC time")
    jobs.choices["stream"].add_argument("--follow", action="store_true")
    jobs.choices["stream"].add_argument("--files-per-batch", type=int, default=FILES_PER_BATCH)
    jobs.choices["stream"].add_argument("--batch-rows", type=int, default=0, help="deliver and commit at most so many events at a time, in order")
    jobs.choices["stream"].add_argument("--dedup-delay", help="for example '30 seconds'")
    jobs.choices["load"].add_argument("--raw", required=True)
    jobs.choices["load"].add_argument("--format", default="json")
    return top


def main(argv=None, spark=None):
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName(f"tidemark-{args.job}").getOrCreate()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    args.run(session, args)
    if spark is None:
        discard_scratch(session)
        session.stop()


if __name__ == "__main__":
    main()
