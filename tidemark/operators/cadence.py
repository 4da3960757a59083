"""When a consumer commits, and when it reports progress."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.joins import null_safe
from tidemark.plans.positions import with_position
from tidemark.plans.workspace import settle
from tidemark.schemas import EVENT_ORDER

# Commit and report cadence.
COMMIT_EVERY = 10
BATCHED_COMMIT_EVERY = 100
BATCHED_COMMIT_SECONDS = 30
REPORT_EVERY = 50

# Rows of one key folded in one task, and block summaries combined in one task.
BLOCK_ROWS = 200_000
BLOCK_FAN = 1_000


def every_nth(events: DataFrame, n: int, keys=("consumer_id",), order=EVENT_ORDER, name="rn") -> DataFrame:
    """Progress marks: each n-th event of a key."""
    return with_position(events, keys, order, name).filter(F.col(name) % n == 0)


def commit_points_count(events: DataFrame, n=COMMIT_EVERY, keys=("consumer_id",), order=EVENT_ORDER) -> DataFrame:
    """Each n-th event of a key commits; ``commit_no`` counts the commits."""
    return every_nth(events, n, keys, order, "_rn").withColumn("commit_no", (F.col("_rn") / n).cast("long")).drop("_rn")


def commit_points_final(events: DataFrame, n=COMMIT_EVERY, keys=("consumer_id",), order=EVENT_ORDER) -> DataFrame:
    """As :func:`commit_points_count`, and the last event of a key commits what is left."""
    ranked = with_position(events, keys, order, "_rn", "_total")
    return (
        ranked.filter((F.col("_rn") % n == 0) | (F.col("_rn") == F.col("_total")))
        .withColumn("commit_no", F.ceil(F.col("_rn") / n).cast("long"))
        .drop("_rn", "_total")
    )


def commit_points_count_or_time(
    events: DataFrame,
    n=BATCHED_COMMIT_EVERY,
    seconds=BATCHED_COMMIT_SECONDS,
    keys=("consumer_id",),
    order=EVENT_ORDER,
    block_rows=BLOCK_ROWS,
    fan=BLOCK_FAN,
) -> DataFrame:
    """Commit after ``n`` events, or at the first event ``seconds`` after the last commit.

    Both counters restart at a commit, so the points form a chain: the one after event p is
    min(p + n, first event at least ``seconds`` later). It reaches at most n events ahead, so a
    block of consecutive events, together with the n before it, maps "last commit k events before
    the block" to "last commit k' events before its end". Blocks are computed in parallel, their
    maps are composed, and each block then follows the chain from its own entry. No task holds
    more than one block. ``n`` in the result is the number of events in the commit.
    """
    keys = list(keys)
    block_rows = max(block_rows, n)
    schema = events.schema
    gap = int(seconds * 1_000_000)
    ranked = with_position(events.select(*keys, *order), keys, order, "_rn")
    own = F.floor((F.col("_rn") - 1) / block_rows)
    last_of_block = F.pmod(F.col("_rn") - 1, F.lit(block_rows)) >= block_rows - n
    blocks = ranked.select(
        *keys,
        F.unix_micros(F.col(order[0]).cast("timestamp")).alias("_us"),
        F.col(order[1]).alias("_id"),
        F.col("_rn"),
        own.alias("_own"),
        # the tail of a block is also the run-up of the next one
        F.explode(F.when(last_of_block, F.array(own, own + 1)).otherwise(F.array(own))).alias("_block"),
    )
    key_ddl = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)

    def maps(pdf):
        links, lead, size = _chain(pdf, n, gap)
        if size == 0:
            return pdf.iloc[:0][[*keys, "_block"]].assign(_map=pd.Series(dtype=object))
        ends = _follow_to_end(links)
        exits = len(links) - ends[:lead][::-1]
        first = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**first, "_block": [pdf["_block"].iloc[0]], "_map": [exits.astype(np.int64).tolist()]})

    table = settle(
        blocks.drop("_id").groupBy(*keys, "_block").applyInPandas(maps, f"{key_ddl}, _block bigint, _map array<bigint>"),
        "block-maps",
    )
    count = table.agg(F.max("_block").alias("top")).first().top
    entries = settle(_entries(table, keys, key_ddl, 0 if count is None else count + 1, fan), "entries")

    def points(pdf):
        links, lead, _ = _chain(pdf, n, gap)
        entry, hits, steps = int(pdf["_entry"].iloc[0]), [], []
        at, nxt = lead - entry, links.tolist()
        while nxt[at] < len(nxt):
            steps.append(nxt[at] - at)
            at = nxt[at]
            hits.append(at - lead)
        chosen = pdf[pdf["_own"] == pdf["_block"]].sort_values("_rn").iloc[hits]
        return chosen[[*keys, "_id", "_rn"]].assign(n=np.array(steps, dtype=np.int64))

    id_type = schema[order[1]].dataType.simpleString()
    return (
        null_safe(blocks, entries, [*keys, "_block"])
        .groupBy(*keys, "_block")
        .applyInPandas(points, f"{key_ddl}, _id {id_type}, _rn bigint, n bigint")
        .withColumnRenamed("_id", order[1])
        .withColumnRenamed("_rn", "rn")
    )


def _chain(pdf, n, gap):
    """Where the commit after each row of a block lies: (links, rows before the block, block rows).

    Links at or past the end leave the block. The first block of a key is preceded by one stand-in
    row at the time of its first event: the start of the session.
    """
    pdf = pdf.sort_values("_rn")
    us = pdf["_us"].to_numpy(dtype=np.int64)
    lead = int((pdf["_own"] != pdf["_block"]).sum())
    size = len(us) - lead
    if size and lead == 0:
        us, lead = np.concatenate([us[:1], us]), 1
    later = np.searchsorted(us, us + gap, side="left")
    rows = np.arange(len(us))
    return np.minimum(np.maximum(later, rows + 1), rows + n), lead, size


def _follow_to_end(links):
    """The last commit of the chain that starts at each row, by repeated doubling."""
    rows = np.arange(len(links))
    jump = np.where(links >= len(links), rows, links)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _compose(maps):
    """One map for a run of blocks, in order."""
    through = maps[0]
    for nxt in maps[1:]:
        through = nxt[through - 1]
    return through


def _entries(table, keys, key_ddl, blocks, fan):
    """Per block, how far before it the last commit lies. ``table``: keys, _block, _map."""
    if blocks <= fan:
        return _walk(table.withColumn("_super", F.lit(0).cast("long")).withColumn("_start", F.lit(1).cast("long")), keys, key_ddl)
    grouped = table.withColumn("_super", F.floor(F.col("_block") / fan))

    def merge(pdf):
        maps = [np.asarray(m, dtype=np.int64) for m in pdf.sort_values("_block")["_map"]]
        first = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**first, "_block": [pdf["_super"].iloc[0]], "_map": [_compose(maps).tolist()]})

    merged = settle(
        grouped.groupBy(*keys, "_super").applyInPandas(merge, f"{key_ddl}, _block bigint, _map array<bigint>"), "super-maps"
    )
    above = _entries(merged, keys, key_ddl, math.ceil(blocks / fan), fan)
    starts = above.withColumnRenamed("_block", "_super").withColumnRenamed("_entry", "_start")
    return _walk(null_safe(grouped, starts, [*keys, "_super"]), keys, key_ddl)


def _walk(table, keys, key_ddl):
    """Follow the maps of one run of at most ``fan`` blocks from the run's start."""

    def walk(pdf):
        pdf = pdf.sort_values("_block")
        at, entries = int(pdf["_start"].iloc[0]), []
        for through in pdf["_map"]:
            entries.append(at)
            at = int(through[at - 1])
        return pdf[[*keys, "_block"]].assign(_entry=entries)

    return table.groupBy(*keys, "_super").applyInPandas(walk, f"{key_ddl}, _block bigint, _entry bigint")
