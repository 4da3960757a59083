"""Sharding by fixed virtual slots.

Records hash into thousands of slots that never change. Bytes are summed per slot (a table of at most
``SLOTS`` rows, whatever the corpus), and a versioned map says which shard holds each slot. Rebalancing
edits the map: a new version moves as few slots as even sizes need, and only their rows move.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.plans.positions import with_position
from tidemark.plans.workspace import fresh_path, settle
from tidemark.sources.files import child_names, exists

SLOTS = 8192
OVERHEAD = 16
# Rebalancing stops once the fullest and the emptiest shard differ by less than this share of the mean.
TOLERANCE = 0.001
MAP_SCHEMA = "version int, vslot int, shard int"


def virtual_slot(slots: int, *columns):
    """The fixed slot of a record, from its own columns alone (nulls included)."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


class SlotMap:
    """A stored map from virtual slots to shards, one Parquet folder per version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, version: int, shards: list[int]) -> None:
        rows = [(version, slot, shard) for slot, shard in enumerate(shards)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version}")

    def newest(self) -> int:
        """The number of the newest version, 0 if there is none. A version counts once it is complete."""
        names = [n for n in child_names(self.spark, self.path) if n.startswith("version=")]
        return max([int(n.split("=")[1]) for n in names if exists(self.spark, f"{self.path}/{n}/_SUCCESS")], default=0)

    def shards(self, version: int) -> list[int]:
        """The shard of every slot; as many rows as there are slots."""
        return [r.shard for r in sorted(self.load(version).collect(), key=lambda r: r.vslot)]

    def edit(self, weight: list[int], shards: int) -> int:
        """Rebalance the newest version, or the initial map as version 1, for these bytes per slot, and save the result under
        the next number if a slot moves. Slots of shards that are no longer there are dealt round first. Returns the
        newest number; no version is ever written again."""
        version = self.newest()
        if version == 0:
            version = 1
            self.save(version, initial_map(len(weight), shards))
        current = self.shards(version)
        if len(current) != len(weight):
            raise ValueError(f"the map at {self.path} has {len(current)} slots, not {len(weight)}")
        after = rebalanced([s if s < shards else slot % shards for slot, s in enumerate(current)], weight, shards)
        if after != current:
            version += 1
            self.save(version, after)
        return version


def initial_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt round."""
    return [slot % shards for slot in range(slots)]


def rebalanced(current: list[int], weight: list[int], shards: int) -> list[int]:
    """``current`` with slots moved from the fullest to the emptiest shard until their sizes are near equal.

    Each move takes the slot whose weight is nearest to half the difference, and only if it narrows the gap. A
    shard that no move can improve (a slot as heavy as the whole gap fills it) is set aside, and the others go on.
    """
    moved, held = list(current), [[] for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(current):
        load[shard] += weight[slot]
        if weight[slot]:
            held[shard].append((weight[slot], slot))
    for mine in held:
        mine.sort()
    # The emptiest shard never grows emptier, so what cannot be improved now cannot be later either.
    live = set(range(shards))
    for _ in range(4 * len(current) + shards):
        full, low = max(live, key=lambda s: (load[s], -s)), min(live, key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        if gap <= TOLERANCE * sum(load[s] for s in live) / len(live):
            break
        w, slot = min(held[full], key=lambda x: (abs(2 * x[0] - gap), x))
        if w >= gap:
            live.remove(full)
            continue
        held[full].remove((w, slot))
        held[low].append((w, slot))
        load[full] -= w
        load[low] += w
        moved[slot] = low
    return moved


def shard(docs: DataFrame, shards: int, path: str | None = None, slots: int = SLOTS, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, shard, slot): each record's shard and its gapless place there.

    Size is the text's UTF-8 bytes plus 16. Version 1 of the map deals slots round; each call rebalances the newest
    version under ``path`` and saves the next one if a slot moves, so a later call with more rows moves few slots.
    A record's virtual slot comes from its id and text, so a repeated id does not pull different texts together, and equal
    texts of different ids lie apart: law ``bytes`` speaks of sizes only. Null text: size 16, checksum 0. Null id: hashed
    like any value. Repeated rows each get a place, in one shard, since they are one slot; their places are numbered by
    ranges of rows, so a record repeated very often is no single task. Among equal rows which one comes first
    does not matter. Very long texts count with all their bytes. Empty input: an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    body = text_of(f"`{text}`").cast("binary")
    rows = settle(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            virtual_slot(slots, F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("vslot"),
        ),
        "records",
    )
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    maps = SlotMap(spark, path or fresh_path(spark, "slot-map"))
    version = maps.edit([totals.get(s, (0, 0))[0] for s in range(slots)], shards)
    # Where each slot's rows begin in its shard: a running count over the slots, bounded like the map.
    filled, begins = [0] * shards, []
    for slot, target in enumerate(maps.shards(version)):
        begins.append((slot, filled[target]))
        filled[target] += totals.get(slot, (0, 0))[1]
    starts = spark.createDataFrame(begins, "vslot int, _start long")
    layout = maps.load(version).drop("version").join(F.broadcast(starts), "vslot")
    placed = with_position(rows, ["vslot"], ["doc_id", "text_crc32", "size"], "_place")
    return (
        placed.join(F.broadcast(layout), "vslot")
        .withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", "vslot", "shard", "slot")
    )
