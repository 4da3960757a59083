import pytest
from pyspark.sql import functions as F

from tests.util import T0, events, ids
from tidemark import Consumer, OffsetStore
from tidemark.sources.store import Position
from tidemark.sources.tables import create_if_absent, write_by_day

SECOND = 1_000_000


@pytest.fixture
def store(spark, folder):
    return OffsetStore(spark, folder + "/store")


def reader(spark, store, rows, consumer_id="prod-consumer-1", **options):
    frame = events(spark, rows)
    return Consumer(store, lambda: frame, consumer_id, "events", **options)


def test_first_run_five_events_restart(spark, store):
    five = [(f"event-{i}", i) for i in range(5)]
    first = reader(spark, store, five)
    assert first.position() == Position(0, None, 0, None, 0, -1)
    assert len(ids(first.consume().events)) == 5
    at = first.position()
    assert (at.micros, at.doc_id, at.total) == (T0 + 4 * SECOND, "event-4", 5)
    again = reader(spark, store, five + [("event-5", 5)])
    assert ids(again.consume().events) == ["event-5"]
    status = again.status().first()
    assert (status.session_processed, status.total_processed, status.last_doc_id) == (1, 6, "event-5")


def test_independent_consumers(spark, store):
    rows = [(f"e{i}", i) for i in range(4)]
    one, two = reader(spark, store, rows, batch_size=3), reader(spark, store, rows, "prod-consumer-2", batch_size=2)
    one.consume(), two.consume()
    assert (one.position().total, two.position().total) == (3, 2)
    assert store.latest().count() == 2


def test_batches_are_delivered_once_without_a_commit_between(spark, store):
    consumer = reader(spark, store, [(f"e{i:02d}", i) for i in range(7)], batch_size=3)
    got = [sorted(ids(consumer.consume().events)) for _ in range(4)]
    assert [len(g) for g in got] == [3, 3, 1, 0]
    assert len(set(sum(got, []))) == 7


def test_old_backlog_is_read_and_seek_delivers_again(spark, store):
    consumer = reader(spark, store, [("old", -86_400), ("new", 0)])
    assert consumer.drain() == 1
    consumer.reset()
    assert sorted(ids(consumer.consume().events)) == ["new", "old"]
    consumer.seek(T0 - SECOND)
    assert ids(consumer.consume().events) == ["new"]
    assert consumer.consume().events.isEmpty()
    assert consumer.position().total == 5


def test_seek_is_exact_although_reads_start_early(spark, store):
    consumer = reader(spark, store, [("a", 0), ("b", 10), ("c", 20), ("d", 21)])
    consumer.consume()
    consumer.seek(T0 + 10 * SECOND)
    consumer.batch_size = 1
    assert consumer.drain() == 2
    handled = store.handled_by("prod-consumer-1", "events").filter("epoch = 1")
    assert sorted(ids(handled)) == ["c", "d"]


def test_late_event_is_caught_by_the_window_and_the_position_stays(spark, store):
    reader(spark, store, [("a", 0), ("b", 100)]).consume()
    later = reader(spark, store, [("a", 0), ("b", 100), ("late", 71), ("too-late", 70)])
    assert ids(later.consume().events) == ["late"]
    at = later.position()
    assert (at.micros, at.doc_id, at.total) == (T0 + 100 * SECOND, "b", 3)
    assert later.consume().events.isEmpty()


def test_exact_mode_and_prefix(spark, store):
    rows = [(f"completion_{i:02d}", 5) for i in range(8)] + [("other", 5)]
    consumer = reader(spark, store, rows, prefix="completion_", safety_seconds=None, batch_size=3)
    assert consumer.drain() == 3
    assert consumer.position().total == 8
    consumer.seek(T0 + 5 * SECOND)
    assert consumer.consume().events.isEmpty()
    consumer.seek(T0 + 4 * SECOND)
    assert consumer.consume().events.count() == 3


def test_copies_in_one_batch_are_handled_once(spark, store):
    consumer = reader(spark, store, [("a", 0), ("a", 0), ("b", 1), ("a", 5)])
    assert sorted(ids(consumer.consume().events)) == ["a", "b"]
    assert consumer.consume().events.isEmpty()
    assert consumer.position().total == 2


def test_default_ids_and_read_only_form(spark, store):
    rows = events(spark, [("completion_1", 1), ("other", 2)])
    first = Consumer.read_only(store, lambda: rows, "events")
    assert first.consumer_id == "readonly-consumer-events"
    assert ids(first.consume().events) == ["completion_1"]
    made = {Consumer(store, lambda: rows, None, "events").consumer_id for _ in range(2)}
    assert len(made) == 2 and all(m.startswith("consumer-") and len(m) == 17 for m in made)
    assert store.stats().first().docs == 1 and store.stats().first().bytes > 0
    assert OffsetStore(spark, store.root + "-none").stats().first().docs == 0


def test_manual_commit(spark, store):
    consumer = reader(spark, store, [("a", 0)])
    batch = consumer.consume(commit=False)
    assert ids(consumer.consume(commit=False).events) == ["a"]
    for _ in range(2):  # committing the same batch again changes nothing
        consumer.commit(batch)
    assert consumer.position().total == 1
    assert consumer.consume().events.isEmpty()


def test_failure_keeps_the_prefix_and_the_open_attempt(spark, store, folder):
    consumer = reader(spark, store, [(str(i), i) for i in range(1, 6)], sink=folder + "/sink")
    consumer.consume(ok=F.col("doc_id") != "3")
    assert consumer.position().doc_id == "2"
    assert store.open_attempts().count() == 1
    assert consumer.position().query_start is not None
    assert sorted(ids(consumer.consume().events)) == ["3", "4", "5"]
    assert store.open_attempts().count() == 0
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["1", "2", "3", "4", "5"]


def test_crash_between_ledger_and_offset_loses_nothing(spark, store, folder):
    consumer = reader(spark, store, [("a", 0), ("b", 1)], sink=folder + "/sink")
    batch = consumer.consume(commit=False)
    store.record_handled("prod-consumer-1", "events", batch.position.commit_seq + 1, batch.events)
    assert sorted(ids(consumer.consume().events)) == ["a", "b"]
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["a", "b"]
    assert store.handled_by("prod-consumer-1", "events").count() == 2


def test_hook_runs_on_the_batch(spark, store, folder):
    consumer = reader(spark, store, [("a", 0)], sink=folder + "/sink")
    consumer.consume(lambda df: df.select(F.upper("event_type").alias("kind")))
    assert spark.read.parquet(folder + "/sink").first().kind == "VIEW"
    with pytest.raises(Exception):
        reader(spark, store, [("b", 9)]).consume(lambda df: df.select(F.raise_error(F.lit("no"))))
    assert consumer.position().doc_id == "a"


def test_commit_leaves_an_open_mark_alone(spark, store):
    attempt = store.mark_start("c", "events")
    store.save("c", "events", Position(T0, "a", 1, None, 0, 0))
    assert [r.attempt for r in store.open_attempts().collect()] == [attempt]
    assert store.load("c", "events").safe_start == T0
    store.clear_start("c", "events")
    assert store.open_attempts().count() == 0


def test_mark_before_the_position_moves_the_start_back(spark, store):
    store.save("c", "events", Position(T0, "a", 1, None, 0, 0))
    store.mark_start("c", "events", T0 - 5 * SECOND)
    assert store.load("c", "events").safe_start == T0 - 5 * SECOND
    row = store.start_columns().select(F.unix_micros("effective_start"), F.unix_micros("safe_start")).first()
    assert tuple(row) == (T0 - 5 * SECOND, T0 - 5 * SECOND)
    assert store.mark_start("c", "events", T0 + 5 * SECOND) == 1
    store.clear_start("c", "events")
    assert store.load("c", "events").query_start is None


def test_store_keys_deletes_and_replays(spark, store):
    for consumer, index in [("a_b", "c"), ("a", "b_c"), ("x/y=z %", "e:1")]:
        for _ in range(2):
            store.save(consumer, index, Position(T0, "id", 3, None, 0, 0))
    assert store.log().count() == 3
    assert {(r.consumer_id, r.index_name) for r in store.latest().collect()} == {("a_b", "c"), ("a", "b_c"), ("x/y=z %", "e:1")}
    assert store.load("x/y=z %", "e:1").total == 3
    assert store.exists("a", "b_c") and not store.exists("a", "c")
    store.delete_offset("a", "b_c")
    assert not store.exists("a", "b_c")
    assert store.load("a", "b_c").is_new
    store.delete_offset("never", "there")
    assert store.load("a_b", "c", before=0).commit_seq == -1


def test_compaction_changes_no_result(spark, store):
    rows = [(f"e{i}", i) for i in range(9)]
    consumer = reader(spark, store, rows, batch_size=3)
    for _ in range(2):
        consumer.consume()
    at = consumer.position()
    numbered = [sorted(map(str, df.collect())) for df in (store.log(), store.ledger().select("doc_id", "commit_seq"))]
    for _ in range(2):
        store.compact("prod-consumer-1", "events")
        assert consumer.position() == at
        assert [sorted(map(str, df.collect())) for df in (store.log(), store.ledger().select("doc_id", "commit_seq"))] == numbered
        assert store.load("prod-consumer-1", "events", before=1).total == 3
        assert sorted(ids(store.ledger())) == [f"e{i}" for i in range(6)]
    assert sorted(ids(consumer.consume().events)) == ["e6", "e7", "e8"]
    store.compact("prod-consumer-1", "events")
    assert store.ledger().select("commit_seq").distinct().count() == 3
    assert store.ledger().count() == 9 and store.log().count() == 3
    assert consumer.consume().events.isEmpty()


def test_unreadable_store_raises(spark, store, folder):
    import pathlib

    store.save("c", "events", Position(T0, "a", 1, None, 0, 0))
    for f in pathlib.Path(folder).rglob("*.parquet"):
        f.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        store.load("c", "events")


def test_consumer_waits_for_a_table_that_appears(spark, store, folder):
    from tidemark.sources.events import scan_if_present

    path = folder + "/events"
    consumer = Consumer(store, lambda: scan_if_present(spark, path), "c", "events")
    assert consumer.consume().events.isEmpty()
    create_if_absent(spark, path)
    assert consumer.consume().events.isEmpty()
    write_by_day(events(spark, [("a", 0)]), path)
    assert ids(consumer.consume().events) == ["a"]


def test_everything_in_one_batch(spark, store):
    consumer = reader(spark, store, [(f"e{i:03d}", i % 7) for i in range(200)], batch_size=None)
    assert consumer.consume().events.count() == 200
    assert consumer.position().total == 200
