"""Batch and stream on one store, compaction before a replay, and rows that lack a key, a time or an outcome."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import Flaky, add_file, pipeline, source
from tests.util import T0, events, ids
from tidemark import Consumer, OffsetStore
from tidemark.operators.failures import prefix_before_failure
from tidemark.plans.positions import with_position, with_running_max
from tidemark.sources.files import delete
from tidemark.sources.store import Position
from tidemark.sources.tables import upsert_into, write_by_day


def batch_reader(spark, folder, store, **options):
    return Consumer(store, lambda: spark.read.parquet(folder + "/in"), "c", "events", sink=folder + "/batches", **options)


def delivered(spark, folder):
    out = []
    for part in ("sink", "batches"):
        try:
            out += ids(spark.read.parquet(f"{folder}/{part}"))
        except Exception as e:
            assert "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e)
    return sorted(out)


@pytest.mark.parametrize("skip", [True, False])
def test_batch_then_stream_then_batch(spark, folder, skip):
    add_file(spark, folder + "/in", [(f"a{i}", i) for i in range(10)])
    store = OffsetStore(spark, folder + "/store")
    batch_reader(spark, folder, store, batch_size=4).drain()
    add_file(spark, folder + "/in", [(f"b{i}", 100 + i) for i in range(4)])
    store, run = pipeline(spark, folder, skip_handled=skip)
    run.run(source(spark, folder))
    assert store.load("c", "events").total == 14 and store.load("c", "events").doc_id == "b3"
    add_file(spark, folder + "/in", [("c0", 200)])
    batch_reader(spark, folder, store).drain()
    add_file(spark, folder + "/in", [("d0", 300)])
    _, again = pipeline(spark, folder, skip_handled=True)
    again.run(source(spark, folder))
    assert delivered(spark, folder) == sorted([f"a{i}" for i in range(10)] + [f"b{i}" for i in range(4)] + ["c0", "d0"])
    at = store.load("c", "events")
    assert (at.total, at.doc_id) == (16, "d0")
    numbers = [r.commit_seq for r in store.log().collect()]
    assert len(numbers) == len(set(numbers))


def test_compaction_before_a_replay_keeps_the_sink(spark, folder):
    for i in range(2):
        add_file(spark, folder + "/in", [(f"e{i}{j}", i * 10 + j) for j in range(5)])
    store, run = pipeline(spark, folder, skip_handled=True)
    run.run(source(spark, folder))
    before = [sorted(map(str, df.collect())) for df in (store.log(), store.ledger())]
    store.compact("c", "events")
    delete(spark, f"{run.checkpoint}/commits/1")
    delete(spark, f"{run.checkpoint}/commits/.1.crc")
    _, again = pipeline(spark, folder, skip_handled=True)
    again.run(source(spark, folder))
    assert len(delivered(spark, folder)) == 10 and store.load("c", "events").total == 10
    assert [sorted(map(str, df.drop("last_updated").collect())) for df in (store.log(), store.ledger())][1] == before[1]


def test_a_step_given_up_for_later_commits_is_done_anew(spark, folder):
    add_file(spark, folder + "/in", [("a", 0), ("b", 1)])
    store, run = pipeline(spark, folder, Flaky, skip_handled=True)
    run.fail = (0, "sink")
    with pytest.raises(Exception, match="after the sink"):
        run.start(source(spark, folder)()).awaitTermination()
    add_file(spark, folder + "/other", [("z", 5)])
    other = Consumer(store, lambda: spark.read.parquet(folder + "/other"), "c", "events", sink=folder + "/batches")
    other.consume()
    _, again = pipeline(spark, folder, skip_handled=True)
    again.run(source(spark, folder))
    assert delivered(spark, folder) == ["a", "b", "z"]
    assert store.load("c", "events").total == 3


def test_empty_newest_commit_survives_compaction(spark, folder):
    store = OffsetStore(spark, folder + "/store")
    frame = events(spark, [(f"e{i}", i) for i in range(4)])
    consumer = Consumer(store, lambda: frame, "c", "events", batch_size=2)
    consumer.drain()
    at = consumer.position()
    frame.limit(0).select("doc_id").write.parquet(folder + "/store/consumer_offsets/consumer_id=c/index_name=events/commit_seq=9")
    store.compact("c", "events")
    assert consumer.position() == at and store.log().count() == 2


def test_manual_commit_clears_its_own_mark(spark, folder):
    store = OffsetStore(spark, folder + "/store")
    frame = events(spark, [("a", 0)])
    consumer = Consumer(store, lambda: frame, "c", "events")
    batch = consumer.consume(commit=False)
    later = store.mark_start("c", "events")
    assert store.open_attempts().count() == 2
    consumer.commit(batch)
    assert [r.attempt for r in store.open_attempts().collect()] == [later]


def test_an_event_without_a_time_does_not_stop_a_consumer(spark, folder):
    store = OffsetStore(spark, folder + "/store")
    frame = events(spark, [("a", 0), ("b", 1)])
    broken = frame.withColumn("timestamp", F.when(F.col("doc_id") != "b", F.col("timestamp")))
    consumer = Consumer(store, lambda: broken, "c", "events", batch_size=1)
    assert consumer.drain() == 1 and consumer.position().doc_id == "a"
    assert ids(consumer.undated()) == ["b"]


def test_copies_do_not_fill_a_batch(spark, folder):
    store = OffsetStore(spark, folder + "/store")
    frame = events(spark, [("hot", 0)] * 50 + [(f"e{i}", 1 + i) for i in range(5)])
    for consumer in (Consumer(store, lambda: frame, "c", "events", batch_size=4), Consumer.read_only(store, lambda: frame, "events", "r", prefix=None, batch_size=4)):
        assert consumer.consume().events.count() == 4
        consumer.drain()
        assert consumer.position().total == 6


def test_rows_with_a_null_key_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 1), ("a", 2)], "k string, o long")
    assert sorted((r.k or "", r.o, r.rn, r.n) for r in with_position(df, ["k"], ["o"], total="n").collect()) == [("", 1, 1, 2), ("", 2, 2, 2), ("a", 1, 1, 2), ("a", 2, 2, 2)]
    assert with_running_max(df, ["k"], ["o"], "o").count() == 4


def test_an_unknown_outcome_stops_like_a_failure(spark):
    frame = events(spark, [(f"e{i}", i) for i in range(4)]).withColumn("k", F.lit("x"))
    ok = F.when(F.col("doc_id") != "e2", True)
    assert sorted(ids(prefix_before_failure(frame, ok, ("k",)))) == ["e0", "e1"]


def test_upsert_of_rows_without_a_time(spark, folder):
    schema = "doc_id string, timestamp timestamp, v int"
    day = datetime.datetime(2024, 1, 1)
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    write_by_day(rows(("x", None, 1), ("y", None, 1), ("w", day, 1)), folder + "/t")
    upsert_into(spark, folder + "/t", rows(("z", None, 2)))
    read = lambda: sorted((r.doc_id, r.v) for r in spark.read.parquet(folder + "/t").collect())
    assert read() == [("w", 1), ("x", 1), ("y", 1), ("z", 2)]
    upsert_into(spark, folder + "/t", rows(("x", day, 3), ("y", day, 3), ("z", day, 3)))
    assert read() == [("w", 1), ("x", 3), ("y", 3), ("z", 3)]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_session_zone_changes_no_pending_event(spark, zone):
    from tidemark.operators.fetch import pending_per_consumer
    from tidemark.operators.reports import offset_lag

    begin = datetime.datetime(2024, 3, 10)
    rows = [("i", begin + datetime.timedelta(minutes=m), f"e{m:04d}") for m in range(3000)]

    def found():
        evs = spark.createDataFrame(rows, "index_name string, ts timestamp_ntz, doc_id string")
        at = spark.createDataFrame([("c", "i", rows[360][1], rows[360][2])], "consumer_id string, index_name string, last_ts timestamp_ntz, last_id string")
        order = ("ts", "doc_id")
        return sorted(r.doc_id for r in pending_per_consumer(evs, at, 50, order=order).collect()), [tuple(r) for r in offset_lag(evs, at, order=order).collect()]

    want = found()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert found() == want and len(want[0]) == 50
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_positions_totals_and_start_texts_can_be_set(spark, folder):
    store = OffsetStore(spark, folder + "/store")
    assert store.start_display("c", "events") == "Jan 1, 1970 @ 00:00:00.000" and store.seconds_since_commit("c", "events") is None
    store.update("c", "events", "2024-01-01T00:00:02Z", "b")
    store.increment("c", "events", 3)
    at = store.update_from_display("c", "events", "Jan 1, 2024 @ 01:00:03.000", "d", "Europe/Berlin")
    assert (at.micros, at.doc_id, at.total) == (1704067203_000_000, "d", 3) == tuple(store.load("c", "events"))[:3]
    assert store.start_display("c", "events", "Europe/Berlin") == "Jan 1, 2024 @ 01:00:03.000"
    store.mark_start("c", "events", "2024-01-01T00:00:01Z")
    assert store.start_display("c", "events") == "Jan 1, 2024 @ 00:00:01.000"
    consumer = Consumer(store, lambda: events(spark, [("e", 4), ("e", 4), ("f", 5)]), "c", "events", safety_seconds=None)
    row = consumer.backlog().first()
    assert row.uncommitted == 2 and 0 <= row.seconds_since_commit < 600


def _files(df):
    """The files that rows come from. The bucket is a folder, so its filter chooses files before they are opened."""
    return df.select(F.input_file_name().alias("file")).distinct().count()


def test_a_small_batch_opens_as_few_files_of_a_ledger_ten_times_as_large(spark, folder):
    """Buckets double with the rows; a batch of three ids opens three of them at most, and finds what it must."""
    opened = {}
    for rows in (1_000, 10_000):
        store = OffsetStore(spark, f"{folder}/{rows}", bucket_rows=50)
        ledger = spark.range(rows).select(F.concat(F.lit("e"), "id").alias("doc_id"), F.timestamp_seconds("id").alias("timestamp"))
        for number, part in enumerate(ledger.randomSplit([0.5, 0.5], seed=1)):
            store.record_handled("c", "events", number, part)
            store.save("c", "events", Position(number, f"e{number}", number, None, 0, number))
        store.compact("c", "events")
        ids = spark.createDataFrame([("e7",), ("e123",), ("new",)], "doc_id string")
        found = store.handled_by("c", "events", ids)
        opened[rows] = _files(found)
        assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert {r.doc_id for r in found.join(ids, "doc_id", "left_semi").collect()} == {"e7", "e123"}
        assert store.handled_by("c", "events").count() == rows
        assert _files(store.handled_by("c", "events")) > 10
        # a commit that is not gathered yet is found as well, null ids do no harm
        store.record_handled("c", "events", 2, spark.createDataFrame([("new", None)], "doc_id string, timestamp timestamp"))
        later = store.handled_by("c", "events", ids.unionByName(spark.createDataFrame([(None,)], "doc_id string")))
        assert later.filter("doc_id = 'new'").count() == 1
    assert opened[10_000] <= opened[1_000] <= 3


def test_a_stream_skips_what_a_compacted_ledger_holds(spark, folder):
    add_file(spark, folder + "/in", [(f"e{i}", i) for i in range(30)])
    store = OffsetStore(spark, folder + "/store", bucket_rows=4)
    frame = spark.read.parquet(folder + "/in")
    Consumer(store, lambda: frame, "c", "events", batch_size=10, sink=folder + "/batches").drain()
    for _ in range(2):
        store.compact("c", "events")
    add_file(spark, folder + "/in", [("e3", 500), ("n", 501)])
    _, run = pipeline(spark, folder, skip_handled=True)
    run.run(source(spark, folder))
    assert delivered(spark, folder) == sorted([f"e{i}" for i in range(30)] + ["n"])
    store.seek("c", "events", T0 - 1_000_000)
    _, again = pipeline(spark, folder, skip_handled=True)
    again.run(source(spark, folder))
    assert store.load("c", "events").total == 31 + 31
