import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def truth(rows, q, k):
    own = dict(rows)[q]
    score = lambda v: sum(np.float32(a).astype(float) * np.float32(b).astype(float) for a, b in zip(own, v))
    return sorted(((-score(v), i) for i, v in rows if i != q))[:k]


def test_small_tables_are_searched_exactly(spark):
    random = np.random.default_rng(1)
    rows = [(i, (random.normal(size=8) * random.uniform(0.1, 5)).tolist()) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(40)]
    out = ann.nearest(frame(spark, rows), lambda i: i % 20 == 0, 20).collect()
    assert len(out) == 20 * sum(i % 20 == 0 for i, _ in rows)
    for q in {r.query_id for r in out}:
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        want = truth(rows, q, 20)
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert [-s for *_, s in mine] == pytest.approx([s for s, _ in want])


def test_recall_on_vectors_without_structure(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_ENTRIES", 0)
    vectors = np.random.default_rng(2).normal(size=(6000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    out = ann.nearest(frame(spark, rows), lambda i: i % 100 == 0, 20).toPandas()
    scores = vectors[::100] @ vectors.T
    scores[np.arange(60), np.arange(0, 6000, 100)] = -np.inf
    found = [len(set(g.vec_id) & set(np.argsort(-scores[q // 100])[:20])) / 20 for q, g in out.groupby("query_id")]
    assert len(found) == 60 and np.mean(found) >= 0.9


def test_who_takes_part(spark):
    rows = [(0, [1, 0]), (20, [1, 0]), (1, [0.5, 0]), (2, None), (3, [0, 0]), (4, [math.nan, 1]), (5, [math.inf, 1]), (6, [None, 1]), (7, []), (8, [1, 2, 3]), (None, [1, 1]), (1, [0.5, 0]), (40, None)]
    df = frame(spark, rows).withColumn("v", F.lit(1)).withColumn("unit", F.lit("x"))
    out = ann.nearest(df, lambda i: i % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in out] == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.nearest(frame(spark, [(0, [1, 2])]), lambda i: i % 20 == 0).count() == 0


def test_cells_split_hot_leaves(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(400, 6)))]
    whole = ann.nearest(frame(spark, rows), lambda i: i % 2 == 0, 5)
    whole = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(ann, "CELL_ROWS", 16)
    assert sorted(map(tuple, ann.nearest(frame(spark, rows), lambda i: i % 2 == 0, 5).collect())) == whole


def test_search_takes_whole_leaves_once_and_in_order():
    points = np.random.default_rng(4).normal(size=(500, 5))
    f = forest.build(points, 3, 20, 1)
    routed = forest.route(f, points)
    sizes = np.bincount(routed.ravel(), minlength=f.leaves)
    assert sizes.sum() == 1500 and sizes.max() <= 20
    own, every = forest.search(f, points[:20], sizes, 1), forest.search(f, points[:20], sizes, 10**9)
    assert all(len(a) == 1 and a[0] in set(r) for a, r in zip(own, routed))
    assert all(sorted(e) == list(range(f.leaves)) for e in every)
    assert len(forest.build(np.ones((50, 3)), 2, 10, 1).leaf_tree) == 2
