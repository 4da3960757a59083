"""Near-duplicate documents: SuperMinHash signatures, banding, verification on whole sets, components.

Equal texts become one node first, so a group of copies costs one row. Nodes that share a band meet in that
band's bucket. Buckets are never expanded into all pairs: each member is compared with its bucket's leader,
and what that links is grouped. Then only members of *different* groups that share a bucket are compared, and
of these only pairs that exact upper bounds of their intersection leave open. So no link between different
groups is lost, and a large group of near copies costs a few comparisons a member.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.components import components
from tidemark.llm.superminhash import bands, mixed, signatures
from tidemark.plans.workspace import settle

# 42 bands of 6: a pair at similarity 0.8 shares no band with probability 3e-6, one at 0.9 with 1e-14.
BANDS = 42
ROWS = 6
# Buckets of this many open members get a leader to compare against; smaller ones have few pairs anyway.
LED_MEMBERS = 8
# Bits for the shingles that a node has besides its leader's, and what is kept of a node beside its leader.
FAR_BITS = 512
PARTS = "bits array<long>, outside long, far array<long>, hidden long"
# Set elements and texts that are put through one call; bounds a task's memory.
CHUNK_ELEMENTS = 20_000
CHUNK_SETS = 400

_SIGNED = pa.schema([("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case: bytes fold and split on exactly the characters wanted."""
    return text.encode().lower().split()


def shingle_set(words: list[bytes], width: int) -> set:
    """Distinct runs of ``width`` words; all words as one run if there are fewer; empty without words."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def hashed_shingles(words, width, memo) -> np.ndarray:
    """64-bit hashes of the distinct shingles."""
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(h))
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for i in range(width):
            total = mixed(total + h[i : len(h) - width + 1 + i])
    return np.unique(total)


def _signed(width):
    slots = BANDS * ROWS

    def chunk(texts, memo):
        words = [tokens(t) for t in texts]
        sets = [hashed_shingles(w, width, memo) if w else np.zeros(0, np.uint64) for w in words]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keys = bands(signatures(np.concatenate(sets), owner, len(sets), slots), BANDS)
        return [
            (len(s), xxhash.xxh3_128_digest(b" ".join(w)), k) if w else (0, None, None)
            for s, w, k in zip(sets, words, keys, strict=True)
        ]

    def run(batches):
        memo = _WordHashes()
        for batch in batches:
            at = 0
            while at < len(batch):
                texts, size = [], 0
                while at < len(batch) and len(texts) < CHUNK_SETS and size < CHUNK_ELEMENTS * 8:
                    texts.append(batch.column(2)[at].as_py())
                    size += len(texts[-1])
                    at += 1
                made = zip(*chunk(texts, memo), strict=True)
                arrays = [pa.array(column, type=f.type) for column, f in zip(made, _SIGNED, strict=True)]
                rows = batch.slice(at - len(texts), len(texts))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *arrays], names=["doc_id", "text_hash", *_SIGNED.names])

    return run


def _links(width, similarity):
    """Keep the pairs of texts whose sets are similar enough. The set of the first text is kept between rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for part in parts:
            linked = []
            for a, text_a, text_b in zip(part["a"], part["text_a"], part["text_b"], strict=True):
                if a != key:
                    key, held = a, shingle_set(tokens(text_a), width)
                other = shingle_set(tokens(text_b), width)
                both = len(held & other)
                linked.append(100 * both >= similarity * (len(held) + len(other) - both))
            yield part.loc[linked, ["a", "b"]]

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return settle(with_b.select("a", "b", "text_a", "text_b").mapInPandas(_links(width, similarity), "a binary, b binary"), "links")


def _grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the group (root) of each node; a node without links is its own group."""
    roots = components(links).toDF("node", "root")
    return members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _hashes(width):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _WordHashes()
        for part in parts:
            found = [hashed_shingles(tokens(t), width, memo).view(np.int64) for t in part["text"]]
            yield pd.DataFrame({"node": part["node"], "hashes": found})

    return run


def _marked(shingles) -> np.ndarray:
    """A bitmap of shingles by their hashes. Two sets have at most as many in common as their bitmaps, and what the
    fuller of either set's bits hides."""
    mask = np.zeros(FAR_BITS, dtype=bool)
    mask[[xxhash.xxh3_64_intdigest(b" ".join(s)) % FAR_BITS for s in shingles]] = True
    return mask


def _against_leader(width):
    """Which shingles of its leader a node has, as bits, how many it has besides, and these as a bitmap (``far``)
    in which ``hidden`` of them share a bit."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, place = None, None
        for part in parts:
            bits, outside, far, hidden = [], [], [], []
            for a, text_a, text_b in zip(part["a"], part["text_a"], part["text_b"], strict=True):
                if a != key:
                    key, place = a, {s: i for i, s in enumerate(sorted(shingle_set(tokens(text_a), width)))}
                own = shingle_set(tokens(text_b), width)
                mask = np.zeros(-(-len(place) // 64) * 64, dtype=bool)
                shared = [place[s] for s in own if s in place]
                mask[shared] = True
                bits.append(np.packbits(mask).view(np.int64))
                outside.append(len(own) - len(shared))
                marked = _marked(s for s in own if s not in place)
                far.append(np.packbits(marked).view(np.int64))
                hidden.append(outside[-1] - int(marked.sum()))
            columns = {"bits": bits, "outside": outside, "far": far, "hidden": hidden}
            yield pd.DataFrame({"leader": part["a"], "node": part["b"], **columns})

    return run


def _with_bounds(open_rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``open_rows`` with what bounds an intersection from above: ``sole``, the shingles of the node that no
    other open node has, and, in larger buckets, the node's part of the leader's shingles (bits, outside)."""
    open_texts = texts.join(open_rows.select("node").distinct(), "node", "left_semi")
    hashes = open_texts.mapInPandas(_hashes(width), "node binary, hashes array<long>").select("node", F.explode("hashes").alias("h"))
    sole = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("node")).filter("held = 1")
    sole = sole.groupBy("node").agg(F.count(F.lit(1)).alias("sole"))
    led = open_rows.groupBy("band").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("leader"))
    led = settle(led.filter(F.col("held") >= LED_MEMBERS).select("band", "leader"), "leaders")
    rows = open_rows.join(led, "band", "left")
    pairs = settle(rows.filter("leader IS NOT NULL").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    parts = settle(with_b.mapInPandas(_against_leader(width), f"leader binary, node binary, {PARTS}"), "parts")
    return rows.join(sole, "node", "left").join(parts, ["leader", "node"], "left").withColumn("sole", F.coalesce("sole", F.lit(0)))


def _may_link(similarity: int):
    """False only for pairs whose intersection cannot be large enough. Shingles that one node alone has are in
    no intersection; of the others, those inside the leader's are counted, those outside bounded by their bitmaps."""
    both = lambda c: F.aggregate(
        F.zip_with(f"{c}_a", f"{c}_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x
    )
    inside = both("bits")
    outside = F.greatest(F.lit(0), F.least(F.col("outside_a") - F.col("sole_a"), F.col("outside_b") - F.col("sole_b")))
    outside = F.least(outside, both("far") + F.least("hidden_a", "hidden_b"))
    # least() passes over the null of a bucket without a leader.
    most = F.least(F.col("n_a") - F.col("sole_a"), F.col("n_b") - F.col("sole_b"), inside + outside)
    return 100 * most >= similarity * (F.col("n_a") + F.col("n_b") - most)


def _unlike(pairs: DataFrame, similarity: int) -> DataFrame:
    """Only pairs whose set sizes allow the similarity."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return pairs.filter(small * 100 >= large * similarity)


def link_groups(docs: DataFrame, doc_id="doc_id", text="text", width: int = 5, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, root), one row for each row of ``docs``. ``root`` names the
    component, also where no row of it has an id; null for a text without words.

    Texts are linked if 100 * intersection >= ``similarity`` * union of their sets of ``width``-word shingles
    (A-Z folded); component_id is the smallest id that links reach, kept says whether it is the row's own.

    Null or empty texts, and texts without words: n_shingles 0, linked with nothing, kept. Null id: never a
    component_id; such a row gets that of its component (null if no row of it has an id) and is kept only
    then. Repeated rows: equal results. Rows of one id with different texts are linked by text alone. Very
    long texts are read whole. Empty input: no rows. Other columns are not read.
    """
    body = text_of(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    schema = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>"
    signed = settle(rows.mapInArrow(_signed(width), schema), "signed")

    # One row per different text; equal texts have equal bands, so any of theirs will do. They merge
    # before the shuffle.
    own = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), "text_hash")).alias("source")
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(own, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = settle(nodes, "nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("leader")).filter("held > 1")
    members = settle(buckets.join(shared.select("band", "leader"), "band"), "members")

    # Texts of the nodes that share a bucket, found by the id and hash of one of their rows.
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "source.at", "source.text_hash")
    found = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), "text_hash", "text").join(wanted, ["at", "text_hash"])
    texts = settle(found.dropDuplicates(["node"]).select("node", "text"), "texts")

    sizes = nodes.select(F.col("node").alias("leader"), F.col("n").alias("n_a"))
    led = members.filter("node != leader").groupBy("leader", "node").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n_b"))
    led = settle(_unlike(led.join(sizes, "leader"), similarity).select(F.col("leader").alias("a"), F.col("node").alias("b"), "times"), "led")
    # First each node against the leader it shares most buckets with ...
    favourite = led.groupBy("b").agg(F.max(F.struct("times", "a")).alias("most")).select("most.a", "b")
    checked = settle(favourite, "pairs")
    links = verified(checked, texts, width, similarity)
    grouped = settle(_grouped(members, links), "grouped")
    # ... then against its other leaders, if they are of another group ...
    root_of = grouped.select("node", "root").distinct()
    apart = led.select("a", "b").join(checked, ["a", "b"], "left_anti")
    apart = apart.join(root_of.toDF("a", "root_a"), "a").join(root_of.toDF("b", "root_b"), "b").filter("root_a != root_b").select("a", "b")
    apart = settle(apart, "pairs")
    checked = checked.unionByName(apart)
    links = links.unionByName(verified(apart, texts, width, similarity))
    grouped = settle(_grouped(members, links), "grouped")
    # ... and last the members of different groups that share a bucket, unless a bound rules the pair out.
    several = grouped.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("band")
    open_rows = settle(grouped.join(several, "band").select("band", "node", "n", "root"), "open")
    # A pair comes out of the first band only that both have, not of each of up to BANDS.
    bands_of = open_rows.groupBy("node").agg(F.sort_array(F.collect_set("band")).alias("all_bands"))
    bounded = settle(_with_bounds(open_rows, texts, width).join(bands_of, "node"), "bounded")
    columns = ("node", "n", "root", "sole", "bits", "outside", "far", "hidden", "all_bands")
    side = lambda k: bounded.select("band", *[F.col(c).alias(f"{c}_{k}") for c in columns])
    first_band = F.array_min(F.array_intersect("all_bands_a", "all_bands_b")) == F.col("band")
    rest = side("a").join(side("b"), "band").filter("root_a < root_b").filter(_may_link(similarity) & first_band)
    rest = rest.withColumnRenamed("node_a", "a").withColumnRenamed("node_b", "b")
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = settle(rest.join(checked, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(verified(rest, texts, width, similarity))

    roots = settle(components(links), "roots")
    placed = signed.select("doc_id", "text_hash", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    named = placed.join(first, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return named.select("doc_id", "n_shingles", "component_id", kept, "text_hash", "root")
