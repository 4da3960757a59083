"""Several writers of one consumer, and a seek that meets a running stream."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.util import T0, events, ids
from tidemark import Consumer, OffsetStore
from tidemark.sources import files
from tidemark.sources.events import stream_events
from tidemark.sources.store import ATTEMPT, CommitConflict, Position
from tidemark.streaming.pipeline import EventPipeline

SECOND = 1_000_000


def add_file(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(path)


def two(spark, folder, rows, first=3, second=6, **options):
    frame = events(spark, rows)
    return [
        Consumer(OffsetStore(spark, folder + "/store"), lambda: frame, "c", "events", batch_size=n, sink=folder + "/sink", **options)
        for n in (first, second)
    ]


def delivered(spark, folder):
    return sorted(ids(spark.read.parquet(folder + "/sink")))


SIX = [(f"d{i}", i) for i in range(6)]


@pytest.mark.parametrize("safety", [30, None])
@pytest.mark.parametrize("order", ["ab", "ba"])
def test_two_pollers_keep_every_event_and_the_position_never_falls(spark, folder, order, safety):
    a, b = two(spark, folder, SIX, safety_seconds=safety)
    batches = {"a": (a, a.consume(commit=False)), "b": (b, b.consume(commit=False))}
    seen = []
    for name in order:
        consumer, batch = batches[name]
        consumer.commit(batch)
        seen.append(a.position().micros)
    at = a.position()
    assert (at.total, at.doc_id) == (6, "d5") and seen == sorted(seen)
    assert delivered(spark, folder) == [f"d{i}" for i in range(6)]
    assert sorted(ids(a.store.ledger())) == [f"d{i}" for i in range(6)]
    assert a.consume().events.isEmpty() and b.consume().events.isEmpty()
    assert a.store.open_attempts().count() == 0


def test_writers_in_threads_deliver_each_event_once(spark, folder):
    frame = events(spark, [(f"e{i:02d}", i) for i in range(24)])
    failures = []

    def work(n):
        try:
            Consumer(OffsetStore(spark, folder + "/store"), lambda: frame, "c", "events", batch_size=n, sink=folder + "/sink").drain()
        except Exception as e:
            failures.append(str(getattr(e, 'java_exception', e))[:3000])

    threads = [threading.Thread(target=work, args=(n,)) for n in (4, 7, 11)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert failures == []
    store = OffsetStore(spark, folder + "/store")
    assert delivered(spark, folder) == [f"e{i:02d}" for i in range(24)]
    assert store.load("c", "events").total == 24 and store.handled_by("c", "events").count() == 24


def test_committing_a_batch_twice_changes_nothing(spark, folder):
    a, _ = two(spark, folder, SIX)
    batch = a.consume(commit=False)
    assert a.commit(batch) == a.commit(batch) == a.position()
    assert a.position().total == 3 and delivered(spark, folder) == ["d0", "d1", "d2"]


def test_a_batch_polled_before_a_seek_is_not_committed(spark, folder):
    a, b = two(spark, folder, SIX)
    batch = a.consume(commit=False)
    b.seek(T0 + SECOND)
    with pytest.raises(CommitConflict):
        a.commit(batch)
    assert a.position().total == 0 and a.position().micros == T0 + SECOND
    assert sorted(ids(b.consume().events)) == ["d2", "d3", "d4", "d5"]
    assert delivered(spark, folder) == ["d2", "d3", "d4", "d5"]


def test_seeks_of_two_writers_follow_each_other(spark, folder):
    store = OffsetStore(spark, folder)
    assert store.seek("c", "events", T0).epoch == 1
    # A writer that still builds on the record before is refused.
    assert not store.publish("c", "events", Position(0, None, 0, None, 0, -1), Position(5, "x", 9, None, 0, 0))
    assert store.seek("c", "events", T0 + 1).epoch == 2
    assert store.increment("c", "events", 4).total == 4
    assert [r.commit_seq for r in store.log().orderBy("commit_seq").collect()] == [0, 1, 2]


def test_a_writer_that_ends_after_publishing_is_finished_by_the_next_reader(spark, folder, monkeypatch):
    a, b = two(spark, folder, SIX)
    batch = a.consume(commit=False)
    with monkeypatch.context() as m:
        m.setattr(OffsetStore, "_finish", lambda self, told: (_ for _ in ()).throw(RuntimeError("ended")))
        with pytest.raises(RuntimeError, match="ended"):
            a.commit(batch)
    assert b.position().doc_id == "d2" and delivered(spark, folder) == ["d0", "d1", "d2"]
    assert sorted(ids(b.consume().events)) == ["d3", "d4", "d5"]


def test_only_one_creator_of_a_file_wins_and_its_content_is_whole(spark, folder):
    won = []
    threads = [threading.Thread(target=lambda n=n: won.append((files.create_with(spark, folder + "/x/head", str(n) * 5000), n))) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (winner,) = [n for ok, n in won if ok]
    assert files.read_text(spark, folder + "/x/head") == str(winner) * 5000
    assert files.child_names(spark, folder + "/x") == ["head"]


def test_compaction_drops_given_up_attempts_only_when_old(spark, folder, monkeypatch):
    a, b = two(spark, folder, SIX, 2, 2)
    a.drain()
    b.consume(commit=False)
    left = f"{a.store._folder('ledger', 'c', 'events')}/{ATTEMPT}gone"
    files.make(spark, left)
    a.store.compact("c", "events")
    assert files.exists(spark, left)
    monkeypatch.setattr("tidemark.sources.store.STALE_SECONDS", -5)
    a.store.compact("c", "events")
    assert not files.exists(spark, left) and a.position().total == 6


def _stream(spark, folder, **options):
    store = OffsetStore(spark, folder + "/store")
    return store, EventPipeline(store, "c", "events", folder + "/sink", folder + "/checkpoint", **options)


def _until(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not condition():
        time.sleep(0.5)
    assert condition()


def test_a_seek_reaches_a_running_stream(spark, folder):
    """Five handled, seek to the second while it polls, two more come: four and the two are delivered."""
    add_file(spark, folder + "/in", [(f"e{i}", i) for i in range(5)])
    store, run = _stream(spark, folder)
    done = threading.Event()
    thread = threading.Thread(target=run.follow, args=(lambda: stream_events(spark, folder + "/in"), 0.5, done.is_set))
    thread.start()
    try:
        _until(lambda: store.load("c", "events").total == 5)
        store.seek("c", "events", T0 + SECOND)
        add_file(spark, folder + "/in", [("e5", 5), ("e6", 6)])
        _until(lambda: store.load("c", "events").total == 10)
        # An idle stream meets a seek as well.
        store.reset("c", "events")
        _until(lambda: store.load("c", "events").total == 17)
    finally:
        done.set()
        thread.join(60)
    at = store.load("c", "events")
    assert (at.epoch, at.doc_id, at.total) == (2, "e6", 17)
    epochs = [r.epoch for r in store.log().orderBy("commit_seq").collect()]
    assert epochs == sorted(epochs)
    sink = spark.read.parquet(folder + "/sink").groupBy("doc_id").count()
    assert {r.doc_id: r["count"] for r in sink.collect()} == {"e0": 2, "e1": 2, **{f"e{i}": 3 for i in (2, 3, 4)}, "e5": 2, "e6": 2}


def test_a_seek_between_two_batches_of_a_run(spark, folder):
    for i in range(3):
        add_file(spark, folder + "/in", [(f"e{i}", i)])

    class Sought(EventPipeline):
        def after_sink(self, batch_id):
            if batch_id == 1 and self.epoch == 0:
                self.store.seek("c", "events", T0)

    store = OffsetStore(spark, folder + "/store")
    run = Sought(store, "c", "events", folder + "/sink", folder + "/checkpoint")
    run.run(lambda: stream_events(spark, folder + "/in", files_per_batch=1), wait=0)
    # e0 was handled before the seek; e1 was in flight and is due again; nothing is committed under the old epoch after it.
    assert delivered(spark, folder) == ["e0", "e1", "e2"]
    at = store.load("c", "events")
    assert (at.epoch, at.total, at.doc_id) == (1, 3, "e2")


def test_a_stream_whose_commit_another_writer_overtook_replays_the_batch(spark, folder):
    add_file(spark, folder + "/in", [("a", 0), ("b", 1)])

    class Overtaken(EventPipeline):
        meddled = False

        def after_sink(self, batch_id):
            if not self.meddled:
                self.meddled = True
                other = Consumer(self.store, lambda: events(spark, [("a", 0), ("z", 9)]), "c", "events", sink=folder + "/batches")
                other.consume()

    store = OffsetStore(spark, folder + "/store")
    run = Overtaken(store, "c", "events", folder + "/sink", folder + "/checkpoint", skip_handled=True)
    assert run.run(lambda: stream_events(spark, folder + "/in"), wait=0) == 1
    assert delivered(spark, folder) == ["b"] and sorted(ids(spark.read.parquet(folder + "/batches"))) == ["a", "z"]
    at = store.load("c", "events")
    assert (at.total, at.doc_id) == (3, "z")
    assert store.handled_by("c", "events").count() == 3


def test_nothing_is_left_aside_after_commits(spark, folder):
    a, b = two(spark, folder, SIX)
    a.consume(ok=F.col("doc_id") != "d0")
    a.drain(), b.drain()
    tables = [folder + "/sink", *[a.store._folder(t, "c", "events") for t in ("ledger", "consumer_offsets")]]
    assert not [n for t in tables for n in files.child_names(spark, t) if n.startswith(ATTEMPT)]
