import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.util import T0, events, ids
from tidemark.operators import fetch
from tidemark.operators.reports import offset_lag
from tidemark.sources.tables import write_by_day


def test_ties_at_the_batch_edge(spark):
    rows = events(spark, [(f"completion_{i:03d}", 5) for i in range(60)])
    first = fetch.fetch_first_run(rows)
    assert len(ids(first)) == 50
    last = first.orderBy("timestamp", "doc_id").tail(1)[0]
    rest = fetch.fetch_resume(rows, T0 + 5_000_000, last.doc_id)
    assert ids(rest) == [f"completion_{i:03d}" for i in range(50, 60)]
    assert ids(fetch.fetch_resume(rows, T0 + 5_000_000)) == []  # the strict bound passes over ties


@pytest.mark.parametrize("k", [1, 7, 50, 1000])
def test_any_batch_size_drains_everything_once(spark, k):
    rng = random.Random(k)
    n = 12 if k == 1 else 120
    rows = events(spark, [(f"completion_{i:03d}", rng.randrange(6)) for i in range(n)] + [("other_1", 1)]).cache()
    seen, at = [], None
    while True:
        batch = fetch.fetch_first_run(rows, k=k) if at is None else fetch.fetch_resume(rows, at[0], at[1], k=k)
        got = [(r.us, r.doc_id) for r in batch.select(F.unix_micros("timestamp").alias("us"), "doc_id").collect()]
        if not got:
            break
        seen += got
        at = got[-1]
    assert seen == sorted(seen)
    assert sorted(d for _, d in seen) == [f"completion_{i:03d}" for i in range(n)]


def test_prefix(spark):
    rows = events(spark, [("completion_1", 1), ("x_completion_1", 1), ("completion", 1)])
    assert ids(fetch.fetch_first_run(rows)) == ["completion_1"]


def test_seen_events_do_not_use_up_the_batch(spark):
    rows = events(spark, [(f"e{i:02d}", i / 10) for i in range(51)])
    seen = rows.filter("doc_id <> 'e50'").select("doc_id", "timestamp")
    assert ids(fetch.fetch_safety_window(rows, seen, T0, k=50)) == ["e50"]


def test_safety_window_is_strict(spark):
    rows = events(spark, [("a", 70), ("b", 71), ("c", 101), ("last", 100)])
    none = rows.limit(0).select("doc_id")
    assert ids(fetch.fetch_safety_window(rows, none, T0 + 100_000_000, "last")) == ["b", "c"]


def test_after_seq(spark):
    rows = spark.range(100).withColumnRenamed("id", "seq")
    assert ids(fetch.fetch_after_seq(rows, 41, 3), "seq") == [42, 43, 44]


def test_resume_bound_reaches_the_scan(spark, folder, capsys):
    write_by_day(events(spark, [("a", 1)]), folder + "/t")
    table = spark.read.parquet(folder + "/t")
    fetch.fetch_resume(table, T0, "a").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(timestamp" in plan and "StringStartsWith(doc_id" in plan
    assert "TakeOrderedAndProject" in plan
    stored = pq.ParquetFile(glob.glob(folder + "/t/*/*.parquet")[0]).schema
    assert [c.physical_type for c in stored if c.name == "timestamp"] == ["INT64"]


# Consumers over shared events: both routes against a plain loop.


def shared(spark, seed, n_events=300, n_consumers=9, step=1):
    rng = random.Random(seed)
    # two thirds of the events are in one index, times are often equal; step 1500 spreads them over hours
    rows = [(rng.choice(["hot", "hot", "cold"]), rng.randrange(40) * step, i) for i in range(n_events)]
    marks = []
    for c in range(n_consumers):
        for index in ("hot", "cold"):
            kind = rng.randrange(4)
            ts = None if kind == 0 else rng.randrange(-2, 42) * step
            marks.append((f"c{c}", index, ts, rng.randrange(n_events) if kind > 1 else None))
    ev = spark.createDataFrame(rows, "index_name string, t long, id long").select(
        "index_name", F.timestamp_seconds("t").alias("timestamp"), F.col("id").alias("doc_id")
    )
    off = spark.createDataFrame(marks, "consumer_id string, index_name string, t long, last_id long").select(
        "consumer_id", "index_name", F.timestamp_seconds("t").alias("last_ts"), "last_id"
    )
    return rows, marks, ev, off


def due(rows, mark):
    _, index, ts, last = mark
    hit = [
        (t, i)
        for x, t, i in rows
        if x == index and (ts is None or t > ts or (t == ts and last is not None and i > last))
    ]
    return sorted(hit)


@pytest.mark.parametrize("max_marks", [256, 0])
@pytest.mark.parametrize("seed, step", [(1, 1), (2, 1500)])
def test_pending_per_consumer(spark, seed, step, max_marks):
    rows, marks, ev, off = shared(spark, seed, step=step)
    got = fetch.pending_per_consumer(ev, off, 7, max_marks=max_marks).collect()
    want = {(m[0], m[1], i, n + 1) for m in marks for n, (_, i) in enumerate(due(rows, m)[:7])}
    assert {(r.consumer_id, r.index_name, r.doc_id, r.rn) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("max_marks", [256, 0])
@pytest.mark.parametrize("seed, step", [(3, 1), (4, 1500)])
def test_offset_lag(spark, seed, step, max_marks):
    rows, marks, ev, off = shared(spark, seed, step=step)
    newest = {x: max(t for y, t, _ in rows if x == y) for x in ("hot", "cold")}
    got = {(r.consumer_id, r.index_name): (r.lag_n, r.lag_s) for r in offset_lag(ev, off, max_marks=max_marks).collect()}
    want = {(m[0], m[1]): (len(due(rows, m)), max(0, newest[m[1]] - (m[2] or 0))) for m in marks}
    assert got == want


def test_few_consumers_far_apart(spark):
    """Most hours lie between two positions and are not needed."""
    rows, _, ev, _ = shared(spark, 6, n_events=500, step=1500)
    marks = [("early", "hot", 1500, None), ("late", "hot", 45_000, 3), ("end", "hot", 10**6, 1)]
    off = spark.createDataFrame(marks, "consumer_id string, index_name string, t long, last_id long").select(
        "consumer_id", "index_name", F.timestamp_seconds("t").alias("last_ts"), "last_id"
    )
    got = fetch.pending_per_consumer(ev, off, 40).collect()
    want = {(m[0], i, n + 1) for m in marks for n, (_, i) in enumerate(due(rows, m)[:40])}
    assert {(r.consumer_id, r.doc_id, r.rn) for r in got} == want
    assert {r.consumer_id: r.lag_n for r in offset_lag(ev, off).collect()} == {m[0]: len(due(rows, m)) for m in marks}


def test_index_with_first_runs_only_and_index_without_events(spark):
    _, _, ev, _ = shared(spark, 5)
    off = spark.createDataFrame(
        [("a", "cold", None, None), ("a", "absent", None, None)],
        "consumer_id string, index_name string, last_ts timestamp, last_id long",
    )
    assert fetch.pending_per_consumer(ev, off, 5).count() == 5
    assert {(r.index_name, r.lag_n > 0) for r in offset_lag(ev, off).collect()} == {("cold", True), ("absent", False)}
