"""Nearest neighbours by largest inner product, through a forest of random-projection trees.

The forest is fitted on a bounded sample; every vector is routed to one leaf of each tree. A query takes
leaves of all trees from one priority queue until they hold a share of all entries. Queries and entries of a
leaf meet in cells of bounded size, which return each query's best; these are scored exactly, in double
precision, on the original vectors.

Inner product becomes angle by one more coordinate: a vector x is extended by sqrt(M^2 - |x|^2), M being the
largest norm, so that all have norm M, and a query by 0.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.forest import build, route, search
from tidemark.plans.workspace import settle

TREES = 12
SAMPLE_ROWS = 32_768
LEAF_POINTS = 128
# A query looks into this share of the forest's entries, and into LEAST_ENTRIES at least. On vectors without
# any structure this finds 0.97 of the true neighbours; on clustered ones more.
SHARE = 0.12
LEAST_ENTRIES = 6_000
CELL_ROWS = 4_096
SEED = 11


def usable(vectors: DataFrame, vec_id="vec_id", embedding="embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: id and vector present, all components finite, not all zero. Of
    rows that repeat an id the least vector counts; of several dimensions only the most frequent takes part."""
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    v = F.col(f"`{embedding}`")
    if kind not in ("float", "double"):
        v = v.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND size(v) > 0").filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return settle(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")


def _stack(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1).astype(np.float64)


def _extended(points: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, norm * norm - np.einsum("ij,ij->i", points, points)))
    return np.column_stack([points, rest]) / norm


def _sum_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products summed component after component, so that equal vectors get equal scores anywhere."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _best(queries: np.ndarray, rows: np.ndarray, keep: int):
    """(query, row, score) of each query's best rows in a cell, more where scores tie in rounding."""
    rough = queries @ rows.T
    if len(rows) > keep:
        least = np.partition(rough, -keep, axis=1)[:, -keep]
        scale = np.abs(rough).max(axis=1)
        q, r = np.nonzero(rough >= (least - 1e-9 * scale)[:, None])
    else:
        q, r = np.nonzero(np.ones_like(rough, dtype=bool))
    return q, r, _sum_in_order(queries[q], rows[r])


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id="vec_id", embedding="embedding", trees=TREES, share=SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, all other rows if there are fewer.

    ``is_query`` is a condition on vec_id. Rank from 1, by falling score, ties to the smaller vec_id. Rows as
    in ``usable``: null, zero or non-finite vectors and null ids take no part, on either side. Equal vectors
    are searched once and listed for each id. A query is never its own neighbour. Empty input: no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = rows.filter(F.size("v") == sizes["dim"])
    kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    # Equal vectors form one unit, named by its least id. No query needs more than k + 1 ids of one unit, and
    # that limit is applied before rows of a unit meet.
    alike = W.partitionBy("v").orderBy("vec_id")
    running = alike.rowsBetween(W.unboundedPreceding, W.currentRow)
    listed = rows.withColumn("place", F.row_number().over(alike)).withColumn("unit", F.first("vec_id").over(running))
    listed = settle(listed.filter(F.col("place") <= k + 1), "units")
    members = listed.select("unit", "vec_id")

    @F.pandas_udf("binary")
    def as_bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.asarray(v, dtype=kind).tobytes() for v in part], dtype=object)

    units = listed.filter("place = 1").select("unit", as_bytes("v").alias("v"))
    units = settle(units, "unit-vectors")
    square = lambda a, x: a + x.cast("double") * x.cast("double")
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), square)))).first()[0]
    sample = units.orderBy(F.xxhash64("unit")).limit(SAMPLE_ROWS).toPandas()
    forest = build(_extended(_stack(sample["v"], kind), norm), trees, LEAF_POINTS, SEED)

    def routed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                leaf = route(forest, _extended(_stack(part["v"], kind), norm)).ravel()
                again = part.iloc[np.repeat(np.arange(len(part)), trees)]
                yield pd.DataFrame({"leaf": leaf, "unit": again["unit"].to_numpy(), "v": again["v"].to_numpy()})

    entries = settle(units.mapInPandas(routed, "leaf long, unit long, v binary"), "entries")
    held = np.zeros(forest.leaves, dtype=np.int64)
    for leaf, count in entries.groupBy("leaf").count().collect():  # as many rows as the forest has leaves
        held[leaf] = count
    wanted = max(LEAST_ENTRIES, int(share * held.sum()))

    def looked_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 512):
                some = part.iloc[at : at + 512]
                points = _stack(some["v"], kind)
                points = np.column_stack([points / np.linalg.norm(points, axis=1, keepdims=True), np.zeros(len(points))])
                taken = search(forest, points, held, wanted)
                again = some.iloc[np.repeat(np.arange(len(some)), [len(t) for t in taken])]
                yield pd.DataFrame({"leaf": np.concatenate(taken), "query_id": again["query_id"].to_numpy(), "v": again["v"].to_numpy()})

    asking = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), as_bytes("v").alias("v"))
    visits = settle(asking.mapInPandas(looked_up, "leaf long, query_id long, v binary"), "visits")
    asked = np.zeros(forest.leaves, dtype=np.int64)
    for leaf, count in visits.groupBy("leaf").count().collect():
        asked[leaf] = count

    # A leaf is a grid of cells of at most about CELL_ROWS entries by CELL_ROWS queries.
    grid = [(leaf, int(-(-held[leaf] // CELL_ROWS)) or 1, int(-(-asked[leaf] // CELL_ROWS)) or 1) for leaf in range(forest.leaves)]
    cut = lambda: F.broadcast(spark.createDataFrame(grid, "leaf long, down int, across int"))  # noqa: E731  one row a leaf
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = entries.join(cut(), "leaf").withColumn("i", dealt("unit", "down")).withColumn("j", every("across"))
    right = visits.join(cut(), "leaf").withColumn("j", dealt("query_id", "across")).withColumn("i", every("down"))

    def ranked(cell: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if not len(cell) or not len(questions):
            return pd.DataFrame({"query_id": [], "unit": [], "score": []})
        q, r, score = _best(_stack(questions["v"], kind), _stack(cell["v"], kind), k + 1)
        return pd.DataFrame({"query_id": questions["query_id"].to_numpy()[q], "unit": cell["unit"].to_numpy()[r], "score": score})

    cells = left.groupBy("leaf", "i", "j").cogroup(right.groupBy("leaf", "i", "j"))
    found = cells.applyInPandas(ranked, "query_id long, unit long, score double").distinct()
    by_unit = W.partitionBy("query_id").orderBy(F.desc("score"), "unit")
    found = found.withColumn("place", F.row_number().over(by_unit)).filter(F.col("place") <= k + 1).drop("place")
    by_row = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.join(members, "unit").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(by_row))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
