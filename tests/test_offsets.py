from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.util import T0, events
from tidemark.functions.predicates import other_than
from tidemark.operators import failures, reports
from tidemark.operators import offsets as ops
from tidemark.operators.dedup import dedup_events, drop_seen, processed_flag

OFF = "consumer_id string, index_name string, last_ts timestamp, last_id string, total bigint"
LOG = "consumer_id string, index_name string, commit_seq bigint, last_ts timestamp, total bigint, deleted boolean"


def owned(spark, rows, consumer="c"):
    return events(spark, rows).select(F.lit(consumer).alias("consumer_id"), F.lit("events").alias("index_name"), "*")


def us(row):
    return row.last_ts and int((row.last_ts.replace(tzinfo=None) - __import__("datetime").datetime(2024, 1, 1)).total_seconds())


def test_position_comes_from_one_event_and_never_goes_back(spark):
    handled = owned(spark, [("b", 2), ("a", 1)])
    fresh = spark.createDataFrame([], OFF)
    moved = ops.advance_offsets(handled, fresh).first()
    assert (us(moved), moved.last_id, moved.total) == (2, "b", 2)
    ahead = owned(spark, [("z", 9)]).select("consumer_id", "index_name", F.col("timestamp").alias("last_ts"), F.col("doc_id").alias("last_id"), F.lit(7).cast("long").alias("total"))
    kept = ops.advance_offsets(handled, ahead).first()
    assert (us(kept), kept.last_id, kept.total) == (9, "z", 9)


def test_a_hundred_events_count_a_hundred(spark):
    handled = owned(spark, [(f"e{i}", i) for i in range(100)])
    assert ops.advance_offsets(handled, spark.createDataFrame([], OFF)).first().total == 100


def test_last_handled_may_go_back(spark):
    handled = owned(spark, [("b", 2), ("a", 1)]).withColumn("turn", F.when(F.col("doc_id") == "b", 1).otherwise(2))
    row = ops.last_handled(handled, ["turn"]).first()
    assert (us(row), row.last_id) == (1, "a")


def test_first_increment_yields_one(spark):
    totals = spark.createDataFrame([], "consumer_id string, index_name string, total bigint")
    assert ops.increment_totals(totals, owned(spark, [("a", 1)])).first().total == 1


def test_latest_tombstone_load_exists_delete(spark):
    log = spark.createDataFrame([], LOG).union(
        spark.sql(
            """SELECT * FROM VALUES
               ('a_b', 'c', 1L, timestamp'2024-01-01', 5L, false), ('a_b', 'c', 2L, timestamp'2024-01-02', 9L, false),
               ('a', 'b_c', 1L, timestamp'2024-01-03', 3L, false),
               ('gone', 'c', 1L, timestamp'2024-01-01', 4L, false), ('gone', 'c', 2L, null, 0L, true),
               ('back', 'c', 1L, null, 0L, true), ('back', 'c', 2L, timestamp'2024-01-05', 1L, false)"""
        )
    )
    latest = {(r.consumer_id, r.index_name): r.total for r in ops.latest_offsets(log).collect()}
    assert latest == {("a_b", "c"): 9, ("a", "b_c"): 3, ("back", "c"): 1}
    wanted = spark.createDataFrame([("a_b", "c"), ("gone", "c"), ("new", "c")], "consumer_id string, index_name string")
    loaded = ops.load_offsets(log, wanted, "last_ts", "total").select("consumer_id", F.unix_micros("last_ts").alias("us"), "total")
    assert {tuple(r) for r in loaded.collect()} == {("a_b", T0 + 86_400_000_000, 9), ("gone", 0, 0), ("new", 0, 0)}
    assert {(r.consumer_id, r.found) for r in ops.offset_exists(log, wanted).collect()} == {("a_b", True), ("gone", False), ("new", False)}
    left = ops.latest_offsets(ops.delete_offsets(log, wanted)).select("consumer_id").collect()
    assert {r.consumer_id for r in left} == {"a", "back"}


def test_first_failure_ends_the_batch_per_consumer(spark):
    rows = owned(spark, [("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5)]).unionByName(owned(spark, [("6", 9)], "d"))
    done = failures.prefix_before_failure(rows, ~F.col("doc_id").isin("3", "5"))
    assert sorted(r.doc_id for r in done.collect()) == ["1", "2", "6"]


def test_epochs_in_the_ledger(spark):
    rows = owned(spark, [("a", 1), ("b", 2), ("c", 3)])
    led = rows.withColumn("epoch", F.lit(0)).union(rows.filter("doc_id = 'c'").withColumn("epoch", F.lit(1)))
    assert drop_seen(rows, led).count() == 0
    replayed = ops.replay(rows, led, T0 + 1_000_000, 1)
    assert [r.doc_id for r in replayed.collect()] == ["b"]
    assert sorted(r.doc_id for r in ops.replay(rows, led, None, 1).collect()) == ["a", "b"]


def test_dedup_and_flag(spark):
    rows = owned(spark, [("a", 5), ("a", 1), ("a", 9), ("b", 2)])
    assert {(r.doc_id, r.s) for r in dedup_events(rows).select("doc_id", F.unix_seconds("timestamp").alias("s")).collect()} == {
        ("a", T0 // 1_000_000 + 1),
        ("b", T0 // 1_000_000 + 2),
    }
    assert dedup_events(rows).columns == rows.columns
    led = rows.filter("doc_id = 'a'")
    assert {(r.doc_id, r.processed) for r in processed_flag(rows, led).collect()} == {("a", True), ("b", False)}
    assert processed_flag(rows, led).count() == 4


def test_other_than(spark):
    rows = owned(spark, [("a", 1), ("b", 2)])
    assert rows.filter(other_than(F.col("doc_id"), "a")).count() == 1
    assert rows.filter(other_than(F.col("doc_id"), None)).count() == 2
    assert rows.filter(other_than(F.col("doc_id"), "")).count() == 2


def test_reports(spark):
    log = spark.sql(
        """SELECT consumer_id, index_name, commit_seq, timestamp_seconds(at) AS last_ts, total, false AS deleted FROM VALUES
           ('c', 'events', 1L, 100, 10L), ('c', 'events', 2L, 130, 20L), ('c', 'events', 4L, 190, 40L), ('d', 'events', 1L, 50, 1L)
           AS t(consumer_id, index_name, commit_seq, at, total)"""
    )
    led = spark.sql("SELECT 'c' AS consumer_id, 'events' AS index_name, string(id) AS doc_id, id AS commit_seq FROM range(1, 8)")
    status = {r.consumer_id: (r.total, r.session_n) for r in reports.consumer_status(log, led, 3).collect()}
    assert status == {"c": (40, 5), "d": (1, 0)}
    backlog = reports.commit_backlog(log, led, 200_000_000).collect()
    assert {(r.consumer_id, r.uncommitted, r.ms_since) for r in backlog} == {("c", 3, 10_000), ("d", 0, 150_000)}
    often = {r.consumer_id: (r.commits, r.avg_gap_s) for r in reports.commit_frequency(log, "last_ts").collect()}
    assert often == {"c": (3, 45.0), "d": (1, None)}
    totals = reports.session_totals(led, 3).first()
    assert (totals.session_n, totals.total_n) == (5, 7)


def test_table_stats(spark, folder):
    spark.range(1000).repartition(3).write.parquet(folder + "/t")
    import glob
    import os

    size = sum(os.path.getsize(f) for f in glob.glob(folder + "/t/*.parquet"))
    row = reports.table_stats(spark.read.parquet(folder + "/t")).first()
    assert (row.docs, row.bytes) == (1000, size)


@pytest.mark.parametrize("ok", [True])
def test_no_failure_keeps_everything(spark, ok):
    rows = owned(spark, [("1", 1), ("2", 2)])
    assert failures.prefix_before_failure(rows, F.lit(ok)).count() == 2


def test_sketches_of_commit_gaps_merge_and_keep_their_error(spark):
    """A skewed spread of gaps in five parts that share their border commits, against the exact ranks."""
    import random

    dice, us, rows = random.Random(4), 0, []
    for number in range(6000):
        us += int(dice.expovariate(1) ** 3 * 1_000_000)
        rows.append(("hot", "events", number, us))
    rows += [("once", "events", 0, 5), (None, "events", 0, 10), (None, "events", 1, 40), ("gone", "events", 0, None)]
    log = spark.createDataFrame(rows, "consumer_id string, index_name string, commit_seq long, us long").withColumn("last_updated", F.timestamp_micros("us"))
    cuts = range(0, 6001, 1200)
    parts = [reports.gap_sketches(log.filter(F.col("commit_seq").between(max(0, lo - 1), hi - 1))) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    merged = reports.merged_gap_sketches(reduce(DataFrame.unionByName, parts))
    shares = (0.01, 0.25, 0.5, 0.9, 0.99)
    got = {r.consumer_id: r for r in merged.select("consumer_id", "gaps", "longest_us", *[reports.gap_quantile(q).alias(f"q{q}") for q in shares]).collect()}
    assert set(got) == {"hot", None} and (got[None].gaps, got[None].longest_us) == (1, 30)
    times = [r[3] for r in rows[:6000]]
    gaps = sorted(b - a for a, b in zip(times, times[1:], strict=False))
    assert (got["hot"].gaps, got["hot"].longest_us) == (5999, gaps[-1])
    for q in shares:
        value = got["hot"][f"q{q}"]
        low, high = sum(g < value for g in gaps) / len(gaps), sum(g <= value for g in gaps) / len(gaps)
        assert low - reports.GAP_RANK_ERROR <= q <= high + reports.GAP_RANK_ERROR, q
    assert reports.gap_sketches(log.limit(0)).count() == 0
