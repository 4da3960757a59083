"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of equal bytes. With weight w, its block k may run from slot
floor(k / w) and must have run by slot ceil((k + 1) / w); among the blocks that may run, the one with the
earliest deadline does. Every prefix of the mix then holds each source to within one block of its share.

Weights are whole units. With a_i units of T in all, the schedule repeats every T slots, so only one frame of
T slots is worked out; the slot of any block follows by arithmetic, in parallel. When a source runs out, the
others go on with their units (a new phase). A phase is worked out only as far as it lasts, for the sources that
get a turn in it, so all phases together take no more rows and steps than there are blocks.
"""

import bisect
import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.plans.workspace import fresh_path, prepare, settle

BLOCK_BYTES = 1 << 16
OVERHEAD = 16
# Units in all, or this many a source if that is more: so many sources do not level each other's weights.
UNITS = 256
UNITS_PER_SOURCE = 32
# Frame entries the driver holds before it writes them.
WRITE_ENTRIES = 200_000
# Blocks of a phase row that one task places at a time.
STRETCH = 4096


def tempered(sizes: dict, exponent: float = 0.5, units: int = UNITS) -> dict:
    """Weights in proportion to size ** exponent, as whole units, at least 1 each: about ``units`` in all, or
    UNITS_PER_SOURCE a source. A source of mean weight or more is off by less than 1/UNITS_PER_SOURCE of it."""
    powers = {s: max(1, n) ** exponent for s, n in sizes.items()}
    units = max(units, UNITS_PER_SOURCE * len(sizes))
    total = sum(powers.values())
    return {s: max(1, round(units * p / total)) for s, p in powers.items()}


def frame(units: dict) -> dict:
    """{source: [slot of its 1st, 2nd, ... block]} over one period of sum(units) slots: earliest deadline first
    among the blocks whose release time has come, ties by source."""
    period = sum(units.values())
    names = sorted(units, key=lambda s: (s is not None, s))
    waiting = [(0, i, 0) for i in range(len(names))]  # (release, source, block)
    ready, slots = [], {s: [] for s in units}
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // units[names[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        slots[names[i]].append(slot)
        if k + 1 < units[names[i]]:
            heapq.heappush(waiting, ((k + 1) * period // units[names[i]], i, k + 1))
    return slots


def _turns(classes: dict, common: int, period: int):
    """The sources of one period in turn, as ``frame`` orders them. ``classes``: {units: sources by name}. Sources
    of equal units release and end their blocks together and come in order of their names, so the heap holds one
    entry a class, not one a source."""
    waiting, ready = [], []
    for u, members in classes.items():
        ready.append((-(-period * common // u), members[0], u, 0, 0))
    heapq.heapify(ready)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        _, i, u, k, at = heapq.heappop(ready)
        yield i
        members = classes[u]
        if at + 1 < len(members):
            heapq.heappush(ready, (-(-(k + 1) * period * common // u), members[at + 1], u, k, at + 1))
        elif (k + 1) * common < u:
            following = (-(-(k + 2) * period * common // u), members[0], u, k + 1, 0)
            heapq.heappush(waiting, ((k + 1) * period * common // u, following))


def runs(blocks: dict, units: dict):
    """(phase, source, first block, blocks, first slot, units, period, [slot of its k-th block of a period]) until
    every source's blocks are placed, for the sources with blocks in a phase. Slots beyond those are left out."""
    names = sorted(blocks, key=lambda s: (s is not None, s))
    left, done = [blocks[s] for s in names], [0] * len(names)
    classes, fewest = defaultdict(list), defaultdict(list)
    for i, s in enumerate(names):
        if left[i]:
            classes[units[s]].append(i)
            fewest[units[s]].append((left[i], i))
    for heap in fewest.values():
        heapq.heapify(heap)
    start = number = 0
    while classes:
        common = math.gcd(*classes)
        period = sum(u // common * len(members) for u, members in classes.items())
        for heap in fewest.values():
            while heap[0][0] != left[heap[0][1]]:
                heapq.heappop(heap)
        turns = min((heap[0][0] - 1) // (u // common) for u, heap in fewest.items())
        # Whole periods in which no source runs out, then the one in which the first does.
        slots, length = defaultdict(list), None
        for x, i in enumerate(_turns(classes, common, period)):
            slots[i].append(x)
            if length is None and len(slots[i]) == left[i] - turns * (units[names[i]] // common):
                length, out = x + 1, i
                if not turns:
                    break
        for i, mine in slots.items():
            own = units[names[i]] // common
            placed = turns * own + bisect.bisect_left(mine, length)
            if placed:
                yield number, names[i], done[i], placed, start, own, period, mine
                done[i] += placed
                left[i] -= placed
                if i != out:
                    heapq.heappush(fewest[units[names[i]]], (left[i], i))
        members = classes[units[names[out]]]
        del members[bisect.bisect_left(members, out)]
        if not members:
            del classes[units[names[out]]], fewest[units[names[out]]]
        start += turns * period + length
        number += 1


def phases(blocks: dict, units: dict):
    """(phase rows, frame rows) of ``runs``.

    Phase: (phase, source, first block, blocks, first slot, units, period). Frame: (phase, source, k, slot).
    """
    found = list(runs(blocks, units))
    return [r[:7] for r in found], [(r[0], r[1], k, x) for r in found for k, x in enumerate(r[7])]


def _block_slots(spark, blocks: dict, units: dict) -> DataFrame:
    """(s, b, slot): source, block and slot of every block. The runs are written in portions."""
    schema, path = "s string, first long, n long, start long, units long, period long, slots array<long>", fresh_path(spark, "runs")

    def write(rows):
        prepare(spark).createDataFrame(rows, schema).write.mode("append").parquet(path)

    rows, entries = [], 0
    for run in runs(blocks, units):
        rows.append(run[1:])
        entries += 1 + len(run[7])
        if entries >= WRITE_ENTRIES:
            write(rows)
            rows, entries = [], 0
    write(rows)
    stretches = spark.read.schema(schema).parquet(path).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))))
    upto = F.least("n", F.col("from") + STRETCH) - 1

    def placed(k):
        at = F.get("slots", (k % F.col("units")).cast("int"))
        slot = F.col("start") + F.floor(k / F.col("units")) * F.col("period") + at
        return F.struct((F.col("first") + k).alias("b"), slot.cast("long").alias("slot"))

    # Placed before they are exploded, so that no row carries a frame.
    spread = stretches.select("s", F.explode(F.transform(F.sequence("from", upto), placed)).alias("at"))
    return settle(spread.select("s", "at.b", "at.slot"), "block-slots")


def _running_bytes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``before``: bytes of the source's rows that come earlier in hash order. Range partitions
    split a large source; each adds the total of the partitions before it."""
    order = ["source", "order", "doc_id", "text_hash"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seat", F.monotonically_increasing_id())
    laid = settle(laid, "ordered").withColumn("part", F.shiftright("seat", 33))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = laid.groupBy("source", "part").agg(F.sum("bytes").alias("n"))
    parts = settle(parts.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "parts")
    inside = W.partitionBy("source", "part").orderBy("seat").rowsBetween(W.unboundedPreceding, -1)
    local = laid.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    same = local["source"].eqNullSafe(parts["source"]) & (local["part"] == parts["part"])
    return local.join(parts, same).select(*[local[c] for c in rows.columns], (F.col("base") + F.col("inside")).alias("before"))


def schedule(
    docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES, doc_id="doc_id", text="text", source="source"
) -> DataFrame:
    """(doc_id, source, text_hash, bytes, before, block, slot): the place of each different (id, source, text).
    The mix is the documents by slot, then by ``before``.

    ``weights``: whole units for every source; without, units in proportion to the root of a source's bytes.
    Bytes: those of the text plus 16, times the number of repeated rows (which share one place). A block holds
    the documents that begin in its stretch of ``block_bytes`` of the source, in hash order of their ids; a
    longer document runs over the stretches behind it. No document is left out: sources that run out leave the
    rest to the others. Null text: empty. Null source: a source of its own. Null id: ordered like a value.
    A source without a weight: an error. Empty input: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    body = text_of(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.xxhash64(body).alias("text_hash"),
        (F.octet_length(body.cast("binary")) + OVERHEAD).cast("long").alias("bytes"),
    )
    rows = rows.groupBy("doc_id", "source", "text_hash").agg(F.sum("bytes").alias("bytes")).withColumn("order", F.xxhash64("doc_id"))
    placed = settle(_running_bytes(rows).drop("order"), "running")
    sizes = {r["source"]: r["n"] for r in placed.groupBy("source").agg(F.sum("bytes").alias("n")).collect()}
    units = weights or tempered(sizes)
    slots = _block_slots(spark, {s: -(-n // block_bytes) for s, n in sizes.items()}, {s: units[s] for s in sizes})
    blocked = placed.withColumn("block", F.floor(F.col("before") / F.lit(block_bytes)).cast("long"))
    timed = blocked.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return timed.select("doc_id", "source", "text_hash", "bytes", "before", "block", "slot")


def mixed(docs: DataFrame, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """All rows of ``docs``, laid out in the order of the mix: partitions are stretches of it, sorted inside."""
    placed = settle(schedule(docs, doc_id=doc_id, text=text, source=source, **options), "schedule")
    # A struct compares null fields as equal; a null struct never arises.
    keyed = placed.select("slot", "before", F.struct("doc_id", "source", "text_hash").alias("_mixed"))
    own = F.struct(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.xxhash64(text_of(f"`{text}`")).alias("text_hash"),
    )
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), own.alias("_mixed"))
    ordered = packed.join(keyed, "_mixed").repartitionByRange("slot", "before").sortWithinPartitions("slot", "before")
    return ordered.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
