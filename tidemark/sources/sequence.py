"""Sequence numbers given at ingest: gapless over all loads, whoever loads.

A load counts its rows, claims the next range of that length by creating a file that must not exist yet, and deals the
range to its rows in order, partition by partition. Two loads at once get ranges that follow each other; a load
that is repeated under its token gets the range it had, so what it wrote before is written again with the same numbers.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.positions import with_position
from tidemark.schemas import EVENT_ORDER
from tidemark.sources.files import child_names, create_with, read_text


class Sequence:
    """The ranges claimed under ``path``, one small file a load."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _claim(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/claim={number}"))

    def _newest(self) -> int:
        return max([int(n.split("=")[1]) for n in child_names(self.spark, self.path) if n.startswith("claim=")], default=-1)

    def next(self) -> int:
        """The number that the next load begins with."""
        newest = self._newest()
        if newest < 0:
            return 0
        last = self._claim(newest)
        return last["first"] + last["n"]

    def claim(self, n: int, token: str) -> int:
        """The first of ``n`` numbers that no other load has. Under the token of an earlier claim, that claim's."""
        seen = -1
        while True:
            newest = self._newest()
            after = 0
            # Claims that came since the last look; one of them may be this load's own.
            for number in range(newest, seen, -1):
                held = self._claim(number)
                if number == newest:
                    after = held["first"] + held["n"]
                if held["token"] == token:
                    if held["n"] != n:
                        raise ValueError(f"load {token} claimed {held['n']} numbers before and has {n} rows now")
                    return held["first"]
            if newest == seen >= 0:
                last = self._claim(newest)
                after = last["first"] + last["n"]
            told = json.dumps({"token": token, "first": after, "n": n})
            if create_with(self.spark, f"{self.path}/claim={newest + 1}", told):
                return after
            seen = newest


def numbered(rows: DataFrame, sequence: Sequence, token: str, order=EVENT_ORDER, name="seq") -> DataFrame:
    """``rows`` with their sequence numbers, in ``order`` within this load (null times first).

    ``token`` names the load: repeated with the same rows, it gives the same numbers. No rows: an empty claim.
    """
    whole = "_whole"
    while whole in rows.columns:
        whole = "_" + whole
    placed = with_position(rows.withColumn(whole, F.lit(0)), [whole], order, name).drop(whole)
    first = sequence.claim(placed.count(), token)
    return placed.withColumn(name, F.col(name) + F.lit(first - 1))
