"""Connected components by union-find within tasks and label propagation between them."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.workspace import settle


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over each batch of edges: every node points at the smallest node of its tree."""
    for part in parts:
        parent = {}

        def root(x, parent=parent):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(part["a"], part["b"], strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in parent]
        yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; ``root`` is the smallest node of its component.

    ``edges``: two columns a, b of one orderable type. Each round takes the smallest label among a node and
    its neighbours, then follows labels once more, so long chains halve. Labels are written every round.
    """
    kind = edges.schema["a"].dataType.simpleString()
    tree = settle(edges.mapInPandas(_forest, f"a {kind}, b {kind}").distinct(), "forest")
    both = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        lowest = offered.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = lowest.join(above, "root", "left").select("node", F.least("root", "_up").alias("root"))
        before = labels.select("node", F.col("root").alias("_was"))
        marked = settle(jumped.join(before, "node").withColumn("_moved", F.col("root") != F.col("_was")), "labels")
        labels = marked.select("node", "root")
        if marked.filter("_moved").isEmpty():
            return labels
