import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cadence
from tidemark.operators.lateness import late_within_window
from tidemark.plans.joins import attach_per_key
from tidemark.plans.positions import with_position, with_running_max
from tidemark.plans.topk import first_k


def skewed(spark, n=4000, seed=0, distinct=50):
    """One key holds most rows; times repeat. Rows: (consumer_id, t, id)."""
    rng = random.Random(seed)
    rows = [(rng.choice("aaaaaabc"), rng.randrange(distinct), i) for i in range(n)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "consumer_id string, t long, doc_id long").repartition(6)
    return rows, frame.withColumn("timestamp", F.timestamp_seconds("t"))


def per_key(rows):
    keyed = {}
    for k, t, i in sorted(rows):
        keyed.setdefault(k, []).append((t, i))
    return keyed


def test_position(spark):
    rows, frame = skewed(spark)
    got = {(r.consumer_id, r.doc_id): r.rn for r in with_position(frame, ["consumer_id"], ["timestamp", "doc_id"]).collect()}
    assert got == {(k, i): n + 1 for k, seq in per_key(rows).items() for n, (_, i) in enumerate(seq)}


def test_a_hot_key_is_laid_out_over_several_files(spark):
    from tidemark.plans import positions

    _, frame = skewed(spark, 40_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        laid = positions._lay_out(frame, ["consumer_id"], ["timestamp", "doc_id"])
        parts = laid.filter("consumer_id = 'a'").select("_part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts >= 3


def test_running_max(spark):
    rng = random.Random(3)
    rows = [("k", i, rng.randrange(1000)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, n long, v long").repartition(5)
    got = {r.n: r.high for r in with_running_max(frame, ["k"], ["n"], "v").collect()}
    high, want = None, {}
    for _, n, v in rows:
        want[n] = high
        high = v if high is None else max(high, v)
    assert got == want


def test_late_events(spark):
    seconds = [100, 101, 75, 71, 130, 99, 101, 131, 131]
    rows = spark.createDataFrame([("i", n, s) for n, s in enumerate(seconds)], "index_name string, n long, s long")
    arrived = rows.withColumn("at", F.timestamp_seconds("s"))
    got = {r.n: r.lag_us for r in late_within_window(arrived, ["n"], "at").collect()}
    # 71 is exactly thirty seconds late: outside; 131 again is not late
    assert got == {2: 26_000_000, 6: 29_000_000}


def test_cadence_by_count(spark):
    rows, frame = skewed(spark, 1234)
    got = {(r.consumer_id, r.doc_id, r.commit_no) for r in cadence.commit_points_count(frame, 10).collect()}
    final = {(r.consumer_id, r.doc_id, r.commit_no) for r in cadence.commit_points_final(frame, 10).collect()}
    want, want_final = set(), set()
    for k, seq in per_key(rows).items():
        for n, (_, i) in enumerate(seq, 1):
            if n % 10 == 0:
                want.add((k, i, n // 10))
            if n % 10 == 0 or n == len(seq):
                want_final.add((k, i, -(-n // 10)))
    assert got == want and final == want_final
    marks = {(r.consumer_id, r.rn) for r in cadence.every_nth(frame, 50).collect()}
    assert marks == {(k, n) for k, seq in per_key(rows).items() for n in range(50, len(seq) + 1, 50)}


def fold(seq, n, seconds):
    """The rule as a plain loop."""
    since, count, points = seq[0][0], 0, []
    for t, i in seq:
        count += 1
        if count >= n or t - since >= seconds:
            points.append((i, count))
            since, count = t, 0
    return points


@pytest.mark.parametrize(
    "n, seconds, distinct, block, fan",
    [
        (10, 40, 3000, 16, 3),  # many blocks, several levels of composition
        (10, 10**9, 3000, 10, 2),  # count only
        (100, 5, 3000, 100, 4),  # time mostly
        (7, 3, 40, 64, 5),  # many equal times
        (5, 30, 3000, 10**6, 1000),  # one block
        (1, 30, 3000, 8, 4),  # every event
    ],
)
def test_cadence_by_count_or_time(spark, n, seconds, distinct, block, fan):
    rows, frame = skewed(spark, 900, seed=n, distinct=distinct)
    got = cadence.commit_points_count_or_time(frame, n, seconds, block_rows=block, fan=fan).collect()
    want = {(k, i, c) for k, seq in per_key(rows).items() for i, c in fold(seq, n, seconds)}
    assert {(r.consumer_id, r.doc_id, r.n) for r in got} == want
    assert len(got) == len(want)


def test_cadence_of_nothing(spark):
    _, frame = skewed(spark, 5)
    assert cadence.commit_points_count_or_time(frame.limit(0), 3, 30).count() == 0


@pytest.mark.parametrize("most", [10_000, 0])
def test_attach_per_key_broadcast_and_salted(spark, most):
    _, frame = skewed(spark, 500)
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "consumer_id string, name string")
    left = attach_per_key(frame, names, ["consumer_id"], ["doc_id"], broadcast_rows=most)
    assert left.count() == 500
    assert left.filter("name is null").select("consumer_id").distinct().count() == 1
    inner = attach_per_key(frame, names, ["consumer_id"], ["doc_id"], "inner", broadcast_rows=most)
    assert inner.count() == frame.filter("consumer_id <> 'c'").count()


def test_first_k(spark):
    rows, frame = skewed(spark, 2000)
    got = {(r.consumer_id, r.doc_id, r.rn) for r in first_k(frame, ["consumer_id"], ["timestamp", "doc_id"], 9).collect()}
    assert got == {(k, i, n) for k, seq in per_key(rows).items() for n, (_, i) in enumerate(seq[:9], 1)}


def test_scratch_can_be_discarded(spark):
    from tidemark.plans.workspace import fresh_path, settle
    from tidemark.sources.files import delete, exists

    kept = settle(spark.range(3), "kept")
    assert kept.count() == 3
    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert exists(spark, path)
    delete(spark, path)
    assert not exists(spark, path)
