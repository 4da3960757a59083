"""A Merkle manifest of a dataset: one subroot per source, one root, and a proof for every record.

**Concatenated levels.** Leaves are numbered within their source and cut into aligned blocks of 3**5. A block
keeps each of its levels as one string of hex digests, 64 characters a node. Parents are the hashes of its
substrings of fixed width, three digests each; the siblings of a node are the substrings on its left and right
within its run. The roots of the blocks are the leaves of the next round, until every source has one root; the
subroots, ordered by source, go through the same rounds. Paths come down again block by block.

No task holds more than a block of one source, however many records a source has, and everything is built from
SQL functions. All runs of a block but the source's last one are full, so a block of 243 folds exactly five times.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.joins import null_safe
from tidemark.plans.positions import with_position
from tidemark.plans.workspace import settle

FAN = 3
LEVELS = 5
HEX = 64
# The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left:string,right:string>>"


def digest(text):
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaf(*values):
    """The digest of a record: each value as its UTF-8 length, a colon and itself; a null as a dash."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]
    return digest(F.concat(*told))


def _parents(level):
    """The next level of a block: the digest of every run of three nodes, the last run as it is."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (FAN * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: digest(F.substring(level, r * (FAN * HEX) + 1, F.lit(FAN * HEX)))), "")


def _siblings(level, at):
    """What stands left and right of node ``at`` within its run."""
    place = F.pmod(at, F.lit(FAN)).cast("int")
    at = at.cast("int")
    return F.struct(
        F.substring(level, (at - place) * HEX + 1, place * HEX).alias("left"),
        F.substring(level, at * HEX + (HEX + 1), (FAN - 1 - place) * HEX).alias("right"),
    )


def _blocks(nodes: DataFrame, keys, levels: int) -> DataFrame:
    """(keys, block, total, members, levels, root) of numbered nodes (keys, pos, total, hash, member).

    ``levels`` holds the strings that were folded, from the nodes up; ``root`` is what the last one became. A
    block that is all its key has folds until one node remains, any other one ``levels`` times.
    """
    size = FAN**levels
    node = F.struct((F.col("pos") % size).cast("int").alias("at"), "hash", "member")
    made = nodes.groupBy(*keys, F.floor(F.col("pos") / size).alias("block"), "total").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    made = made.withColumn("_0", F.array_join("nodes.hash", ""))
    for n in range(levels):
        more = (F.col("total") > size) | (F.length(f"_{n}") > HEX)
        made = made.withColumn(f"_{n + 1}", F.when(more, _parents(F.col(f"_{n}"))).otherwise(F.lit(None).cast("string")))
    folded = F.array_compact(F.array(*[F.when(F.col(f"_{n + 1}").isNotNull(), F.col(f"_{n}")) for n in range(levels)]))
    tops = [F.col(f"_{n}") for n in range(levels, -1, -1)]
    member = F.transform("nodes", lambda n: F.struct(n.at, n.member.alias("member")))
    return made.select(*keys, "block", "total", member.alias("members"), folded.alias("levels"), F.coalesce(*tops).alias("root"))


def _fold(nodes: DataFrame, keys, levels: int):
    """(keys, root) for every key, and the blocks of each round."""
    rounds, roots, size = [], None, FAN**levels
    while True:
        blocks = settle(_blocks(nodes, keys, levels), "merkle")
        rounds.append(blocks)
        done = blocks.filter(F.col("total") <= size).select(*keys, "root")
        roots = done if roots is None else roots.unionByName(done)
        left = blocks.filter(F.col("total") > size)
        if left.isEmpty():
            return roots, rounds
        nodes = left.select(
            *keys,
            F.col("block").alias("pos"),
            F.ceil(F.col("total") / size).alias("total"),
            F.col("root").alias("hash"),
            F.lit(None).cast("int").alias("member"),
        )


def _descend(rounds, keys, above: DataFrame, levels: int) -> DataFrame:
    """(keys, member, path) of the first nodes. ``above``: (keys, path) from a key's root upward."""
    size = FAN**levels
    ready = None
    for number in range(len(rounds) - 1, -1, -1):
        blocks = rounds[number]
        held = null_safe(blocks.filter(F.col("total") <= size), above, keys)
        if ready is not None:
            held = held.unionByName(null_safe(blocks, ready, [*keys, "block"]))
        way = F.transform("members", lambda m: F.struct(m.at, m.member.alias("member"), _own_path(m.at).alias("path")))
        opened = held.select(*keys, "block", F.explode(way).alias("m"), F.col("path").alias("up"))
        path = F.concat("m.path", "up").alias("path")
        if number == 0:
            return opened.select(*keys, "m.member", path)
        ready = opened.select(*keys, (F.col("block") * size + F.col("m.at")).alias("block"), path)
    return ready


def _own_path(at):
    """The siblings of member ``at`` in each folded level of its block."""
    return F.transform("levels", lambda level, n: _siblings(level, F.floor(at / F.pow(F.lit(float(FAN)), n))))


def refold(start, path):
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, x: digest(F.concat(x.left, node, x.right)))


def proofs(records: DataFrame, keys=("source",), order=("doc_id",), fields=FIELDS, keep=("doc_id",), tampered=None, levels: int = LEVELS) -> DataFrame:
    """One row per record: ``keep``, leaf, altered, subroot, root and path (left and right siblings, upward).

    ``keys`` name the groups whose records are numbered by ``order``; ``tampered`` maps a field to the expression
    that stands for it in ``altered``, the leaf of a changed record. With ``levels`` of 5 a block holds 243 nodes.

    Nulls: a null field is a dash in the leaf; null keys are one group, first in order; null order values come
    first. Equal order values: by leaf. Repeated rows: each is a leaf of its own. Empty text: length zero, not a dash.
    Very long texts are hashed whole. Empty table: no rows. Clashing names: only ``keep`` is returned, under
    names that no result has; other columns are not read.
    """
    keys, given = [F.col(f"`{c}`") for c in keys], [F.col(f"`{c}`") for c in keep]
    key_names = [f"_key{n}" for n in range(len(keys))]
    kept_names = []
    for c in keep:
        name = c
        while name.lower() in {"leaf", "altered", "subroot", "root", "path"} | {k.lower() for k in kept_names}:
            name = "_" + name
        kept_names.append(name)
    values = {f: F.col(f"`{f}`") for f in fields}
    changed = leaf(*[(tampered or {}).get(f, v) for f, v in values.items()]) if tampered else F.lit(None).cast("string")
    order_names = [f"_order{n}" for n in range(len(order))]
    plain = records.select(
        *[k.alias(n) for k, n in zip(keys, key_names, strict=True)],
        *[F.col(f"`{c}`").alias(n) for c, n in zip(order, order_names, strict=True)],
        leaf(*values.values()).alias("hash"),
        F.struct(*[c.alias(f"k{n}") for n, c in enumerate(given)], changed.alias("altered")).alias("member"),
    )
    # The leaf itself is in the numbered row; the member carries it on, so that paths need no join back.
    plain = settle(plain.withColumn("member", F.struct("member.*", F.col("hash").alias("leaf"))), "leaves")
    placed = with_position(plain, key_names, [*order_names, "hash"], "pos", "total").withColumn("pos", F.col("pos") - 1)
    subroots, rounds = _fold(placed, key_names, levels)

    group = F.struct(*[F.col(k) for k in key_names], F.col("root").alias("subroot")).alias("member")
    tops = subroots.select(F.lit(0).alias("whole"), *key_names, F.col("root").alias("hash"), group)
    tops = with_position(tops, ["whole"], key_names, "pos", "total").withColumn("pos", F.col("pos") - 1)
    whole, top_rounds = _fold(tops, ["whole"], levels)
    start = whole.select("whole", "root", F.lit(None).cast(PATH).alias("path"))
    start = start.withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    above = _descend(top_rounds, ["whole"], start.drop("root"), levels).join(whole, "whole")
    above = settle(above.select("member.*", "path", "root"), "subroots")

    paths = _descend(rounds, key_names, above.drop("subroot", "root"), levels)
    told = null_safe(paths, above.select(*key_names, "subroot", "root"), key_names)
    return told.select(
        *[F.col(f"member.k{n}").alias(name) for n, name in enumerate(kept_names)], "member.leaf", "member.altered", "subroot", "root", "path"
    )


def manifest(records: DataFrame, **options) -> DataFrame:
    """(keys, subroot, root, n): what is published for a dataset, one row per group, from :func:`proofs`.

    The rows of a group agree on its subroot, so a hot group is merged in the tasks that read it.
    """
    keys = options.get("keys", ("source",))
    kept = proofs(records, **{**options, "keep": tuple(keys)})
    return kept.groupBy(*kept.columns[: len(keys)], "subroot", "root").agg(F.count(F.lit(1)).alias("n"))


def newlines_deleted(doc_id="doc_id", text="text"):
    """The text of a record of even crc32(id) without its newlines; other records as they are."""
    even = F.crc32(F.col(doc_id).cast("string")) % 2 == 0
    return F.when(even, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))


def audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every document's proof, and whether its record, with newlines deleted where crc32(doc_id) is even, still
    folds to the root."""
    told = proofs(docs, tampered={"text": newlines_deleted()}, levels=levels)
    folded = refold(F.col("altered"), F.col("path"))
    segments = F.array_join(F.transform("path", lambda x: F.concat(x.left, x.right)), "")
    out = told.select("doc_id", "leaf", "subroot", "root", digest(segments).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
