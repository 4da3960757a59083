import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.util import T0, events, ids
from tidemark import OffsetStore
from tidemark.schemas import EVENTS
from tidemark.sources import files
from tidemark.sources.events import stream_events
from tidemark.sources.tables import create_if_absent
from tidemark.streaming.pipeline import EPOCH_SPAN, EventPipeline, ProgressMarks, dedup_stream, run_to_end, with_backoff


def add_file(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(path)


class Flaky(EventPipeline):
    """Fails when asked to, at one point of one batch."""

    fail = None  # (batch, "sink" or "save")

    def after_sink(self, batch_id):
        if self.fail == (batch_id, "sink"):
            self.fail = None
            raise RuntimeError("after the sink")


def pipeline(spark, folder, kind=EventPipeline, **options):
    store = OffsetStore(spark, folder + "/store")
    return store, kind(store, "c", "events", folder + "/sink", folder + "/checkpoint", **options)


def source(spark, folder, **options):
    return lambda: stream_events(spark, folder + "/in", files_per_batch=1, **options)


def test_files_arrive_and_a_restart_goes_on(spark, folder):
    create_if_absent(spark, folder + "/in")  # the stream may start before there are events
    store, first = pipeline(spark, folder)
    add_file(spark, folder + "/in", [("a", 0), ("b", 1)])
    add_file(spark, folder + "/in", [("c", 2)])
    assert first.run(source(spark, folder)) == 0
    assert store.load("c", "events").total == 3
    add_file(spark, folder + "/in", [("d", 3)])
    _, second = pipeline(spark, folder, process=lambda df: df.withColumn("seen_by", F.lit("second")))
    second.run(source(spark, folder))
    at = store.load("c", "events")
    assert (at.doc_id, at.total, at.micros) == ("d", 4, T0 + 3_000_000)
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["a", "b", "c", "d"]


def test_replayed_batch_counts_once(spark, folder):
    for i in range(3):
        add_file(spark, folder + "/in", [(f"e{i}", i), (f"f{i}", i)])
    store, flaky = pipeline(spark, folder, Flaky)
    flaky.fail = (1, "sink")
    assert flaky.run(source(spark, folder), wait=0) == 1
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["e0", "e1", "e2", "f0", "f1", "f2"]
    assert store.ledger().count() == 6
    assert store.load("c", "events").total == 6
    # a replay after the records were written
    flaky.write_batch(events(spark, [("e2", 2), ("f2", 2)]), 2)
    assert store.load("c", "events").total == 6 and store.ledger().count() == 6


def test_prefix_and_duplicates(spark, folder):
    add_file(spark, folder + "/in", [("completion_1", 0), ("completion_2", 5), ("other", 1)])
    add_file(spark, folder + "/in", [("completion_1", 0), ("completion_3", 6)])
    store, run = pipeline(spark, folder, prefix="completion_", dedup_delay="30 seconds")
    run.run(source(spark, folder))
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["completion_1", "completion_2", "completion_3"]
    assert store.load("c", "events").total == 3


def test_late_rows_within_and_far_beyond_the_watermark(spark, folder):
    add_file(spark, folder + "/in", [("a", 0)])
    add_file(spark, folder + "/in", [("b", 1000)])
    add_file(spark, folder + "/in", [("late", 980)])
    add_file(spark, folder + "/in", [("c", 2000)])
    add_file(spark, folder + "/in", [("d", 2001)])
    add_file(spark, folder + "/in", [("too-late", 100)])
    _, run = pipeline(spark, folder, dedup_delay="30 seconds")
    run.run(source(spark, folder))
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["a", "b", "c", "d", "late"]


def test_exact_cut_behind_the_stored_position(spark, folder):
    """The first batch has no position yet; after it, thirty seconds behind is out."""
    add_file(spark, folder + "/in", [("a", 100), ("early", 10)])
    add_file(spark, folder + "/in", [("late", 71), ("too-late", 70), ("b", 90)])
    store, run = pipeline(spark, folder, safety_seconds=30)
    run.run(source(spark, folder))
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["a", "b", "early", "late"]
    assert (store.load("c", "events").doc_id, store.load("c", "events").total) == ("a", 4)


def test_handled_events_are_skipped_however_old(spark, folder):
    add_file(spark, folder + "/in", [("a", 0)] + [("hot", 5)] * 40)
    add_file(spark, folder + "/in", [("b", 10_000)])
    add_file(spark, folder + "/in", [("a", 0), ("hot", 5), ("c", 20_000), ("c", 20_000)])
    store, run = pipeline(spark, folder, Flaky, skip_handled=True)
    run.fail = (2, "sink")
    run.run(source(spark, folder), wait=0)
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["a", "b", "c", "hot"]
    assert store.load("c", "events").total == 4


def test_seek_begins_a_new_checkpoint(spark, folder):
    add_file(spark, folder + "/in", [("a", 0), ("b", 10), ("c", 20)])
    store, first = pipeline(spark, folder)
    first.run(source(spark, folder))
    store.seek("c", "events", T0 + 10_000_000)
    _, again = pipeline(spark, folder)
    assert again.epoch == 1
    again.run(source(spark, folder))
    sink = spark.read.parquet(folder + "/sink")
    assert ids(sink.filter(F.col("batch_id") >= EPOCH_SPAN)) == ["c"]
    assert store.load("c", "events").total == 4
    assert store.load("c", "events").doc_id == "c"


def test_failure_without_restarts_left_is_raised(spark, folder):
    add_file(spark, folder + "/in", [("a", 0)])

    def broken(df):
        return df.select(F.raise_error(F.lit("always")).alias("x"))

    _, run = pipeline(spark, folder, process=broken)
    with pytest.raises(StreamingQueryException):
        run.run(source(spark, folder), restarts=1, wait=0)


def test_polling_trigger(spark, folder):
    add_file(spark, folder + "/in", [("a", 0)])
    store, run = pipeline(spark, folder)
    query = run.start(source(spark, folder)(), poll_seconds=0.2)
    try:
        query.processAllAvailable()
        assert store.load("c", "events").total == 1
        add_file(spark, folder + "/in", [("b", 1)])
        query.processAllAvailable()
        assert store.load("c", "events").total == 2
        assert query.lastProgress is not None
        status = run.status().first()
        assert (status.session_processed, status.total_processed, status.last_doc_id) == (2, 2, "b")
    finally:
        query.stop()


def _marks_of(spark, run, every, handled=0):
    """The marks that a listener reports while ``run`` works."""
    import time

    marks = []
    listener = ProgressMarks(marks.append, every, handled)
    spark.streams.addListener(listener)
    try:
        run()
        for _ in range(30):
            before = len(marks)
            time.sleep(0.2)
            if marks and len(marks) == before:
                break
    finally:
        spark.streams.removeListener(listener)
    return marks


def test_progress_marks_name_each_multiple_of_events_after_the_filters(spark, folder):
    for start in (0, 30, 60):
        rows = [(f"p_{start + i}", start + i) for i in range(30)] + [(f"x_{start + i}", start + i) for i in range(25)]
        add_file(spark, folder + "/in", rows)
    marks = _marks_of(spark, lambda: pipeline(spark, folder, prefix="p_")[1].run(source(spark, folder)), 20)
    assert marks == [20, 40, 60, 80]
    # another run goes on from what was handled
    add_file(spark, folder + "/in", [(f"p_{90 + i}", 90 + i) for i in range(15)])
    store, run = pipeline(spark, folder, prefix="p_")
    assert _marks_of(spark, lambda: run.run(source(spark, folder)), 20, store.load("c", "events").total) == [100]


def test_progress_marks_count_a_replayed_batch_once(spark, folder):
    for start in (0, 30, 60):
        add_file(spark, folder + "/in", [(f"e{start + i}", start + i) for i in range(30)])
    _, flaky = pipeline(spark, folder, Flaky)
    flaky.fail = (1, "sink")
    assert _marks_of(spark, lambda: flaky.run(source(spark, folder), wait=0), 45) == [45, 90]


@pytest.mark.parametrize("skip", [False, True])
def test_row_exact_batches_in_order_and_the_same_after_a_failure(spark, folder, skip):
    """One file of 23 events (and copies) in parts of 5; the third part fails once."""
    rows = [(f"e{i:02d}", i // 3) for i in range(23)]
    add_file(spark, folder + "/in", (rows + [("e04", 1)] * 7)[::-1] if skip else rows[::-1])

    class Third(EventPipeline):
        parts, failed = 0, False

        def after_sink(self, batch_id):
            self.parts += 1
            if self.parts == 3 and not self.failed:
                self.failed = True
                raise RuntimeError("in the third part")

    store, run = pipeline(spark, folder, Third, batch_rows=5, skip_handled=skip)
    assert run.run(source(spark, folder), wait=0) == 1
    got = {}
    for r in spark.read.parquet(folder + "/sink").collect():
        got.setdefault(r.batch_id, []).append(r.doc_id)
    expected = [[f"e{i:02d}" for i in range(at, min(at + 5, 23))] for at in range(0, 23, 5)]
    assert [sorted(got[k]) for k in sorted(got)] == expected
    assert store.load("c", "events").total == 23
    assert [r.total_processed for r in store.log().orderBy("commit_seq").collect()] == [5, 10, 15, 20, 23]


@pytest.mark.parametrize("process", [False, True])
def test_what_row_exact_parts_write_takes_no_job_for_each_of_them(spark, folder, process):
    """One file in 3 parts, one in 30: the same jobs, but for the one that a ``process`` needs for each part."""
    add_file(spark, folder + "/in", [(f"a{i:02d}", i) for i in range(6)])
    seen = {"process": lambda df: df.withColumn("seen", F.lit(df.count()))} if process else {}
    store, run = pipeline(spark, folder, batch_rows=2, **seen)
    jobs = []
    for _ in range(2):
        query = run.start(source(spark, folder)())
        query.awaitTermination()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))))
        add_file(spark, folder + "/in", [(f"b{i:02d}", 100 + i) for i in range(60)])
    assert jobs[1] <= jobs[0] + 8 if not process else jobs[1] <= jobs[0] + 8 + 27 * 4
    sink = spark.read.parquet(folder + "/sink").groupBy("batch_id").count().collect()
    assert sorted((r.batch_id, r["count"]) for r in sink) == [(i, 2) for i in range(33)]
    log = store.log().orderBy("commit_seq").collect()
    assert [(r.commit_seq, r.total_processed) for r in log] == [(i, 2 * i + 2) for i in range(33)]
    assert [r.last_processed_doc_id for r in log][:4] == ["a01", "a03", "a05", "b01"]
    assert store.ledger().filter("commit_seq = 3").select("doc_id").distinct().count() == 2
    if process:
        assert {r.seen for r in spark.read.parquet(folder + "/sink").collect()} == {2}


def test_a_seek_between_parts_that_are_written_already(spark, folder):
    """Six events in parts of two; after the first part a seek to the second event."""
    add_file(spark, folder + "/in", [(f"e{i}", i) for i in range(6)])

    class Seeks(EventPipeline):
        parts = 0

        def after_sink(self, batch_id):
            self.parts += 1
            if self.parts == 2:
                self.store.seek("c", "events", T0 + 1_000_000)

    store, run = pipeline(spark, folder, Seeks, batch_rows=2)
    assert run.run(source(spark, folder), wait=0) == 0
    assert sorted(ids(spark.read.parquet(folder + "/sink"))) == ["e0", "e1", "e2", "e3", "e4", "e5"]
    assert store.load("c", "events").total == 6 and store.load("c", "events").epoch == 1


def test_names_in_a_folder(spark, folder):
    names = ["a b", "c, d]", "{e}=1", "f,g"]
    for name in names:
        files.make(spark, f"{folder}/{name}")
    assert sorted(files.child_names(spark, folder)) == sorted(names) and files.child_names(spark, f"{folder}/f,g") == []


def test_dedup_needs_no_more_than_the_key(spark, folder):
    add_file(spark, folder + "/in", [("a", 0), ("a", 1)])
    stream = dedup_stream(stream_events(spark, folder + "/in", EVENTS), "1 hour")
    assert stream.isStreaming and stream.columns == EVENTS.names


def test_backoff_doubles_then_raises():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        with_backoff(fail, sleep=waits.append)
    assert (len(calls), waits) == (3, [1.0, 2.0])
    outcomes = iter([OSError("no"), None])

    def second_time():
        outcome = next(outcomes)
        if outcome:
            raise outcome
        return "done"

    assert with_backoff(second_time, sleep=waits.append) == "done"


def test_restarts_wait_between_runs():
    class Ends:
        def __init__(self, failures):
            self.failures = failures

        def __call__(self):
            return self

        def awaitTermination(self):
            if self.failures:
                self.failures -= 1
                raise StreamingQueryException("failed")

    waits = []
    assert run_to_end(Ends(2), sleep=waits.append) == 2
    assert waits == [5.0, 5.0]
    with pytest.raises(StreamingQueryException):
        run_to_end(Ends(9), restarts=3, sleep=waits.append)
