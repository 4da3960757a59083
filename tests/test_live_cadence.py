import random
import time

import numpy as np
from pyspark.sql import functions as F

from tests.util import T0, events, ids
from tidemark import OffsetStore
from tidemark.operators.cadence import commit_points_count_or_time
from tidemark.schemas import CONSUMER_KEY
from tidemark.streaming.cadence import advance, commit_points, commit_while_streaming


def owned(spark, rows):
    """rows: (doc_id, seconds, consumer)."""
    frame = events(spark, [(d, s, c) for d, s, c in rows])
    return frame.withColumnsRenamed({"event_type": "consumer_id", "queryid": "_"}).drop("_").withColumn("index_name", F.lit("i"))


def add(spark, folder, rows):
    owned(spark, rows).coalesce(1).write.mode("append").parquet(folder + "/in")


def stream(spark, folder):
    schema = spark.read.parquet(folder + "/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")


def run(points, folder):
    """To the end of what is there; the sink keeps the points of all runs."""
    query = points.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()


def test_one_step_equals_the_chain_however_it_is_cut():
    dice = random.Random(3)
    us = np.sort(np.array([dice.randint(0, 1000) for _ in range(300)]))
    whole, *_ = advance(us, int(us[0]), 0, 7, 25)
    cut, since, done, at = [], int(us[0]), 0, 0
    while at < len(us):
        size = dice.randint(1, 20)
        points, since, done = advance(us[at : at + size], since, done, 7, 25)
        cut += [(at + p, n, why) for p, n, why in points]
        at += size
    assert cut == whole and {why for _, _, why in whole} == {"count", "time"}


def test_points_of_a_stream_equal_the_batch_chain_across_restarts_and_late_events(spark, folder):
    dice = random.Random(8)
    rows = [(f"e{i:04d}", dice.randint(0, 900), dice.choice("aab")) for i in range(240)]
    rows += [(f"n{i}", 100 * i, None) for i in range(5)]  # a null key is a key
    arrival = sorted(rows, key=lambda r: r[1] + dice.uniform(0, 18))  # up to 18 s late
    for at in range(0, len(arrival), 60):
        add(spark, folder, arrival[at : at + 60])
        run(commit_points(stream(spark, folder), 10, 40, delay="20 seconds"), folder)
    add(spark, folder, [("end", 100_000, "end")])
    run(commit_points(stream(spark, folder), 10, 40, delay="20 seconds"), folder)
    got = spark.read.parquet(folder + "/out").filter("consumer_id IS DISTINCT FROM 'end'")
    chain = commit_points_count_or_time(owned(spark, rows), 10, 40, CONSUMER_KEY)
    told = lambda df: sorted((r.consumer_id or "", r.doc_id, r.n) for r in df.collect())
    assert told(got.filter("reason != 'idle'")) == told(chain)
    # Whatever is left uncommitted is saved when nothing more comes.
    last = got.groupBy("consumer_id").agg(F.max("handled").alias("n"))
    assert {r.consumer_id: r.n for r in last.collect()} == {r.consumer_id: r["count"] for r in owned(spark, rows).groupBy("consumer_id").count().collect()}


def test_events_without_a_time_are_left_out_and_no_events_give_no_points(spark, folder):
    owned(spark, [("a", 0, "c"), ("b", 1, "c")]).withColumn("timestamp", F.when(F.col("doc_id") == "a", F.col("timestamp"))).coalesce(1).write.parquet(folder + "/in")
    add(spark, folder, [("end", 500, "z")])
    run(commit_points(stream(spark, folder), 1, 40, delay="1 second"), folder)
    assert ids(spark.read.parquet(folder + "/out")) == ["a"]


def test_a_timer_commits_when_nothing_more_comes(spark, folder):
    """On the clock: 3 of 10 events, then silence, then two more."""
    add(spark, folder, [("a", 0, "c"), ("b", 1, "c"), ("d", 2, "c")])
    store = OffsetStore(spark, folder + "/store")
    query = commit_while_streaming(store, stream(spark, folder), folder + "/checkpoint", 0.5, n=10, seconds=2)
    try:
        def reached(total):
            until = time.time() + 60
            while time.time() < until and store.load("c", "i").total != total:
                time.sleep(0.5)
            return store.load("c", "i")

        at = reached(3)
        assert (at.total, at.doc_id, at.micros) == (3, "d", T0 + 2_000_000)
        add(spark, folder, [("e", 2.5, "c"), ("f", 3, "c")])
        assert reached(5).doc_id == "f"
    finally:
        query.stop()
    assert [r.commit_seq for r in store.log().orderBy("commit_seq").collect()] == [3, 5]


def test_offsets_of_many_consumers_follow_the_points(spark, folder):
    rows = [(f"{c}{i:02d}", i, c) for c in "xyz" for i in range({"x": 23, "y": 10, "z": 3}[c])]
    add(spark, folder, rows)
    add(spark, folder, [("end", 1000, "~")])
    store = OffsetStore(spark, folder + "/store")
    for _ in range(2):  # the second run finds nothing new
        commit_while_streaming(store, stream(spark, folder), folder + "/checkpoint", n=10, seconds=500, delay="1 second").awaitTermination()
    latest = {r.consumer_id: (r.total_processed, r.last_processed_doc_id) for r in store.latest().collect()}
    assert latest == {"x": (23, "x22"), "y": (10, "y09"), "z": (3, "z02")}
