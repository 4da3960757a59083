"""The trie of conversation prefixes, built by halving sequences as a van Emde Boas layout halves a tree.

**Down.** Sequences of turns are cut at half depth again and again: two neighbouring pieces of equal length make one
piece of twice that length, named by the digest of both names, until every sequence is one piece. That is the
upper trie of one level and the list of cut prefixes of the next. On the way back each cut gets the name of the whole
prefix before it: the first half of a piece starts where the piece starts, the second where the first one ends. A
level is one shuffle over half as many rows as the level below it, and all forests of a level are named together,
so a conversation of any length spreads over tasks by its pieces.

**Up.** Rows of equal prefix names are one node. Totals of subtrees are grafted upward the other way round: in
round k the tries of height 2**k that hang below a cut give the totals of their roots to the up to 2**k ancestors
between that cut and the one above. A node of a single conversation is a chain and needs no round: it has one leaf
and saves nothing. The path of one member is enough to find a node's ancestors, and a node is known by
its smallest member and its depth.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.plans.positions import with_position
from tidemark.plans.workspace import settle

# A conversation takes over up to LONGEST_HEAD first turns of the first conversation of its group of GROUP ids.
GROUP = 5
LONGEST_HEAD = 8
ROOT = ""


def _name(*parts):
    """128 bits as text: the name of a piece, of a prefix, or of a turn."""
    return F.md5(F.concat_ws(":", *parts))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, total, turn_name, bytes), pos from 1 by turn (null first), equal turns by their name."""
    role, text = text_of("role"), text_of("text")
    turn_name = _name(F.octet_length(role).cast("string"), role, text)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        turn_name.alias("turn_name"),
        F.octet_length(text).cast("long").alias("bytes"),
    ).filter("conv_id IS NOT NULL")
    # Without the texts, which the sampling of the ranges would otherwise read a second time.
    return with_position(settle(rows, "turns"), ["conv_id"], ["turn", "turn_name"], "pos", "total").drop("turn")


def head_length(conv_id="conv_id"):
    return F.crc32(F.col(conv_id).cast("string")) % (LONGEST_HEAD + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, lengths): (conv_id, d, name, bytes) from d = 1, and (conv_id, length) of every conversation.

    A conversation c is the first ``head_length(c)`` turns of conversation c - c % GROUP, then its own turns after
    as many. ``turns`` as from :func:`numbered_turns`.
    """
    own = settle(turns.groupBy("conv_id").agg(F.first("total").alias("n")), "conversations")
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = own.withColumns({"h": head_length(), "base": F.col("conv_id") - F.col("conv_id") % GROUP}).join(base, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = plan.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = settle(plan.select("conv_id", "base", "h", "taken", "length"), "plan")
    # Only the first few turns of a base are handed on, to a handful of conversations.
    first = turns.filter(F.col("pos") <= LONGEST_HEAD).withColumnRenamed("conv_id", "base")
    heads = first.join(plan, "base").filter(F.col("pos") <= F.col("h"))
    heads = heads.select("conv_id", F.col("pos").alias("d"), F.col("turn_name").alias("name"), "bytes")
    tails = turns.join(plan, "conv_id").filter(F.col("pos") > F.col("h"))
    depth = F.col("pos") - F.col("h") + F.col("taken")
    tails = tails.select("conv_id", depth.alias("d"), F.col("turn_name").alias("name"), "bytes")
    return settle(heads.unionByName(tails), "sequences"), plan.select("conv_id", "length")


def _prefixes(pieces: DataFrame, longest: int) -> DataFrame:
    """(conv_id, j, before, after): the names of the prefixes that end before and after piece j (from 0)."""
    if longest <= 1:
        return pieces.select("conv_id", "j", F.lit(ROOT).alias("before"), _name(F.lit(ROOT), "name").alias("after"))
    side = F.col("j") % 2
    pairs = pieces.groupBy("conv_id", F.shiftright("j", 1).alias("pair")).agg(
        F.max(F.when(side == 0, F.col("name"))).alias("left_half"), F.max(F.when(side == 1, F.col("name"))).alias("right_half")
    )
    pairs = settle(pairs, "pairs")
    # A pair without a right half is the last of its conversation: nothing lies after it, so its name is not used.
    whole = pairs.select("conv_id", F.col("pair").alias("j"), _name("left_half", F.coalesce("right_half", F.lit(""))).alias("name"))
    upper = _prefixes(whole, (longest + 1) // 2).withColumnRenamed("j", "pair")
    cut = _name("before", "left_half")
    joined = pairs.join(upper, ["conv_id", "pair"])
    first = F.struct((2 * F.col("pair")).alias("j"), F.col("before").alias("before"), cut.alias("after"))
    second = F.struct((2 * F.col("pair") + 1).alias("j"), cut.alias("before"), F.col("after").alias("after"))
    halves = F.when(F.col("right_half").isNull(), F.array(first)).otherwise(F.array(first, second))
    return joined.select("conv_id", F.explode(halves).alias("half")).select("conv_id", "half.*")


def named_paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, d, bytes, parent, name): each row's prefix name and that of the prefix one turn shorter."""
    pieces = sequences.select("conv_id", (F.col("d") - 1).alias("j"), "name")
    longest = pieces.agg(F.max("j").alias("top")).first().top
    if longest is None:
        empty = sequences.select("conv_id", "d", "bytes", F.lit("").alias("parent"), "name")
        return empty.limit(0)
    prefixes = _prefixes(pieces, longest + 1).select("conv_id", (F.col("j") + 1).alias("d"), F.col("before").alias("parent"), F.col("after").alias("name"))
    return settle(sequences.drop("name").join(prefixes, ["conv_id", "d"]), "paths")


def _sealed(batches):
    """SHA-256 over the comma-joined ids of each run of equal names, fed batch by batch."""
    open_name, state = None, None
    for batch in batches:
        names, seals = [], []
        for name, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name == open_name:
                state.update(b",%d" % conv_id)
            else:
                if state is not None:
                    names.append(open_name)
                    seals.append(state.hexdigest())
                open_name, state = name, hashlib.sha256(b"%d" % conv_id)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seals, pa.string())], names=["name", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_name]), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])


def sealed_ends(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id) rows.

    The digest of a list is sequential by definition: the ids that end at one node go through one task, as a sorted
    stream of which no more than a batch is in memory. Ids of the other nodes spread by name.
    """
    return ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_sealed, "name string, ends_sha256 string")


def _grafted(shared: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """``shared`` (name, conv_id, depth, leaves, saved: a node's own share) with the sums over its subtree."""
    # A node's ancestors lie on the path of its smallest member.
    ways = paths.join(shared.select("name"), "name", "left_semi").join(shared.select("conv_id").distinct(), "conv_id", "left_semi")
    roots = shared.filter("depth > 0").select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("name"))
    ways = settle(ways.select("conv_id", "d", "name").unionByName(roots), "ways")
    height = 1
    while height <= deepest:
        block = 2 * height
        below = shared.filter(F.col("depth") % block == height).select(
            "conv_id", F.floor(F.col("depth") / block).alias("block"), F.col("leaves").alias("l"), F.col("saved").alias("s")
        )
        above = ways.filter(F.col("d") % block < height).select("conv_id", F.floor(F.col("d") / block).alias("block"), "name")
        gifts = above.join(below, ["conv_id", "block"]).groupBy("name").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
        added = {c: F.col(c) + F.coalesce(g, F.lit(0)) for c, g in (("leaves", "l"), ("saved", "s"))}
        shared = settle(shared.join(gifts, "name", "left").withColumns(added).drop("l", "s"), "grafted")
        height = block
    return shared


def build(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, d, name, bytes) and the totals of their subtrees.

    ``lengths`` (conv_id, length) lists every conversation, those without a turn as well. One row per node: conv_id
    (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. No conversation: no rows.
    """
    paths = named_paths(sequences)
    member = F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    inner = paths.groupBy("name").agg(*member, F.min("d").alias("depth"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    root = lengths.groupBy(F.lit(ROOT).alias("name")).agg(
        *member, F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("bytes")
    )
    nodes = settle(inner.unionByName(root), "nodes")
    children = nodes.groupBy(F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("chains")
    )
    nodes = nodes.join(children.filter("name IS NOT NULL"), "name", "left").fillna(0, ["n_children", "chains"])
    nodes = settle(nodes, "nodes")

    # What a node counts itself: single conversations that branch off, itself if it has no child, and its last text.
    leaf = (F.col("n_children") == 0).cast("long")
    own = nodes.filter("n_convs > 1").select(
        "name", "conv_id", "depth", (F.col("chains") + leaf).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    )
    own = settle(own, "shared")
    deepest = own.agg(F.max("depth").alias("top")).first().top
    totals = own if not deepest else _grafted(own, paths, deepest)

    last = paths.join(lengths.filter("length > 0").withColumnRenamed("length", "d"), ["conv_id", "d"]).select("name", "conv_id")
    at_root = lengths.filter("length = 0").select(F.lit(ROOT).alias("name"), "conv_id")
    ends = sealed_ends(last.unionByName(at_root))
    parents = nodes.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = (
        nodes.join(totals.select("name", "leaves", "saved"), "name", "left")
        .join(ends, "name", "left")
        .join(parents, "parent", "left")
    )
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text); see :func:`build`.

    Null turn: first. Null role or text: empty. Equal turns of one conversation: by the digest of role and text.
    Repeated rows: turns like others. Null conv_id: the row is in no conversation. Very long texts: only their digest
    and length are kept. A conversation whose head is missing and whose own turns are all skipped has no turn and
    ends at the root. Empty table: no rows. Other columns are not read.
    """
    return build(*rebuilt(numbered_turns(conversations)))
