"""Removal of long repeated byte strings through a logarithmic family of sparse suffix arrays.

**Which suffixes.** Every 400-byte string is assigned one *anchor* inside it: the position, among its first
256, whose 8 bytes hash lowest. The anchor depends on the string alone, so two equal strings have anchors at
the same distance, and comparing the suffixes that begin at anchors (one in about 130) finds every repeat.
Consecutive string starts with the same anchor form one *entry*.

**Suffix arrays.** A batch's entries, ordered by the fingerprint of the anchored suffix's first 145 bytes
(which all strings of an anchor share), are its suffix array: equal long prefixes stand side by side. A new
batch is merge-scanned against every level for shared prefixes, then joins the family; two arrays of one
level merge into one of the next, so n batches keep about log2(n) arrays.

**Exactness.** Entries with a shared prefix are settled in three steps, each an aggregation over fingerprints:
whole entries with equal surroundings; sixteenths of an entry; single strings. A hot passage is counted, never
gathered. Only entries with different surroundings (the edges of passages) reach the later steps.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.plans.workspace import fresh_path, settle, shuffles_dropped
from tidemark.sources.files import delete

LENGTH = 400
WINDOW = 256  # starts over which the anchor is chosen; a power of two
GRAM = 8
PREFIX = LENGTH - WINDOW + 1
STEP = 16
BATCHES = 4

# back_lo/back_hi: least and greatest distance from a string's start to its anchor, over the entry.
ENTRY = "doc_id long, text_hash int, at int, back_lo short, back_hi short, prefix long, context long"
_ENTRY = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int32()),
        ("at", pa.int32()),
        ("back_lo", pa.int16()),
        ("back_hi", pa.int16()),
        ("prefix", pa.int64()),
        ("context", pa.int64()),
    ]
)
_SIGN = 1 << 63


def fingerprint(data: bytes, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    return (xxhash.xxh3_64_intdigest(data, seed) ^ _SIGN) - _SIGN


def anchors(data: bytes):
    """(anchor, first start, last start) of each entry of a text; nothing if it is shorter than a string."""
    n = len(data)
    if n < LENGTH:
        return np.zeros((0, 3), dtype=np.int64)
    grams = np.ndarray((n - GRAM + 1,), dtype="<u8", buffer=data, strides=(1,))
    with np.errstate(over="ignore"):
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < WINDOW:  # the least of each 2, 4, ... neighbours; the position breaks ties to the left
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    at = (h[: n - LENGTH + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return np.stack([at[first], first, last], axis=1)


def _entries(batches):
    for batch in batches:
        doc_ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = [[] for _ in _ENTRY]

        def made(out=out):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _ENTRY, strict=True)], schema=_ENTRY)

        for doc_id, text_hash, text in zip(doc_ids, hashes, batch.column(2), strict=True):
            data = text.as_py().encode()
            for at, lo, hi in anchors(data).tolist():
                row = (
                    doc_id, text_hash, at, at - hi, at - lo,
                    fingerprint(data[at : at + PREFIX]), fingerprint(data[lo : hi + LENGTH], 1),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            if len(out[0]) > 100_000:
                yield made()
                for column in out:
                    column.clear()
        yield made()


class SuffixFamily:
    """Suffix arrays under ``path``, at most one on each level; level n holds 2**n batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.levels, self._made = spark, path, {}, 0

    def _write(self, entries: DataFrame) -> str:
        self._made += 1
        path = f"{self.path}/array-{self._made}"
        # Other columns follow the prefix so that entries of one hot prefix spread over partitions.
        order = ("prefix", "context", "doc_id", "at")
        with shuffles_dropped(self.spark):
            entries.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(path)

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch's entries. Returns the prefixes that the batch repeats, in itself or in the family."""
        array = self._write(batch)
        own = self._read(array).groupBy("prefix").agg(F.count(F.lit(1)).alias("held"))
        repeated = own.filter("held > 1").select("prefix")
        for path in self.levels.values():
            repeated = repeated.unionByName(own.select("prefix").join(self._read(path).select("prefix"), "prefix", "left_semi"))
        repeated = settle(repeated.distinct(), "repeated")
        level = 0
        while level in self.levels:
            below = self.levels.pop(level)
            merged = self._write(self._read(below).unionByName(self._read(array)))
            delete(self.spark, below)
            delete(self.spark, array)
            array, level = merged, level + 1
        self.levels[level] = array
        return repeated

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*self.levels.values())


REF = ["doc_id", "text_hash", "at"]


def _same_ref(left: DataFrame, right: DataFrame, columns):
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def _steps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sixteenths of each entry: the bytes that all its strings share, and all bytes they cover."""
    for part in parts:
        rows = []
        for e in part.itertuples(index=False):
            zero = e.back_hi  # place of the anchor in the surroundings
            for j in range(e.back_lo // STEP, e.back_hi // STEP + 1):
                lo, hi = max(e.back_lo, j * STEP), min(e.back_hi, j * STEP + STEP - 1)
                # Shared by all starts of the sixteenth, also by those that the entry does not reach.
                core = e.bytes[zero - j * STEP : zero + LENGTH - j * STEP - STEP + 1]
                hull = e.bytes[zero - hi : zero - lo + LENGTH]
                rows.append((e.doc_id, e.text_hash, e.at, j, lo, hi, fingerprint(core, j), fingerprint(hull, 2)))
        yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "at", "j", "lo", "hi", "core", "hull"])


def _strings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every single string of a sixteenth."""
    for part in parts:
        rows = []
        for e in part.itertuples(index=False):
            for back in range(e.lo, e.hi + 1):
                start = e.back_hi - back
                rows.append((e.doc_id, e.text_hash, e.at, back, e.core, fingerprint(e.bytes[start : start + LENGTH], 3)))
        yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "at", "back", "core", "string"])


_REF_DDL = "doc_id long, text_hash int, at int"


def _settled(rows: DataFrame, group, context, lo, hi):
    """Split ``rows``, which agree within ``group``: (those whose context occurs twice, one row for each context
    of the groups that still hold a single one beside others)."""
    key = [*group, *context]
    first = F.min(F.struct(*REF)).alias("ref")
    contexts = settle(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held"), first), "contexts")
    twice = rows.join(contexts.filter("held > 1").select(*key), key)
    mixed = contexts.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds"), F.min("held").alias("least"))
    mixed = mixed.filter("kinds > 1 AND least = 1").select(*group)
    return twice.select("doc_id", "text_hash", (F.col("at") - F.col(hi)).alias("start"), (F.col("at") - F.col(lo) + LENGTH).alias("end")), (
        contexts.join(mixed, group).select(*key, "ref.*")
    )


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text_hash, start, end): byte spans that repeated 400-byte strings cover, overlapping. ``docs``
    has doc_id, text_hash and a text that is not null."""
    spark = docs.sparkSession
    found = docs.select("doc_id", "text_hash", "text").mapInArrow(_entries, ENTRY)
    batch = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).alias("batch")
    split = fresh_path(spark, "entries")
    found.withColumn("batch", batch).write.partitionBy("batch").parquet(split)
    family = SuffixFamily(spark, fresh_path(spark, "suffixes"))
    stored = spark.read.schema(f"{ENTRY}, batch int").parquet(split)
    repeated = None
    for b in range(batches):
        more = family.add(stored.filter(F.col("batch") == b).drop("batch"))
        delete(spark, f"{split}/batch={b}")
        repeated = more if repeated is None else repeated.unionByName(more)
    # Written first, so that the join stands between two plain shuffles and a hot prefix can be split.
    repeated = settle(repeated.distinct(), "repeated")
    shared = settle(family.entries().join(repeated, "prefix", "left_semi"), "shared")
    delete(spark, family.path)

    whole, mixed = _settled(shared, ["prefix"], ["context", "back_lo", "back_hi"], "back_lo", "back_hi")
    mixed = settle(mixed, "mixed")
    # The bytes around each entry still open, cut out where its text is read.
    body = F.col("text").cast("binary")
    opened = docs.join(mixed, _same_ref(docs, mixed, ["doc_id", "text_hash"]))
    begin, size = F.col("at") - F.col("back_hi") + 1, F.col("back_hi") - F.col("back_lo") + LENGTH
    cut = F.substring(body, begin, size).alias("bytes")
    opened = settle(opened.select(mixed["doc_id"], mixed["text_hash"], "at", "back_lo", "back_hi", cut).dropDuplicates(REF), "opened")

    steps = settle(opened.mapInPandas(_steps, f"{_REF_DDL}, j int, lo int, hi int, core long, hull long"), "steps")
    parts, mixed_parts = _settled(steps, ["core"], ["hull", "lo", "hi"], "lo", "hi")
    asked = settle(mixed_parts, "mixed-steps")
    single = asked.join(opened, _same_ref(asked, opened, REF)).select(*[asked[c] for c in REF], "back_hi", "lo", "hi", "core", "bytes")
    strings = settle(single.mapInPandas(_strings, f"{_REF_DDL}, back int, core long, string long"), "strings")
    twice = strings.groupBy("core", "back", "string").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    alone = strings.join(twice.select("core", "back", "string"), ["core", "back", "string"], "left_semi")
    # Starts of one entry are closer than a string is long, so what they cover is one span.
    start = F.col("at") - F.col("back")
    alone = alone.groupBy(*REF).agg(F.min(start).alias("start"), F.max(start + LENGTH).alias("end")).drop("at")
    return whole.unionByName(parts).unionByName(alone)


CUT = "kept binary, spans array<struct<start:int,end:int>>"


def _cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    kept, spans = [], []
    for text, start, end in zip(texts, starts, ends, strict=True):
        data = text.encode()
        if start is None or len(start) == 0:
            kept.append(data)
            spans.append([])
            continue
        order = np.argsort(start, kind="stable")
        start, reach = np.asarray(start)[order], np.maximum.accumulate(np.asarray(end)[order])
        opens = np.append(True, start[1:] > reach[:-1])
        firsts, lasts = start[opens], np.append(reach[:-1][opens[1:]], reach[-1])
        mask = np.ones(len(data), dtype=bool)
        for a, b in zip(firsts, lasts, strict=True):
            mask[a:b] = False
        kept.append(np.frombuffer(data, dtype=np.uint8)[mask].tobytes())
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(firsts, lasts, strict=True)])
    return pd.DataFrame({"kept": kept, "spans": spans})


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): each row's bytes that no repeated 400-byte string covers, and the maximal
    removed spans (bytes, end exclusive). Every occurrence of a repeated string goes, its first as well.

    Null text: as the empty text. Texts under 400 bytes: whole. Null ids: rows like others. Repeated rows: each
    repeats the other, so all 400-byte strings of both go. Cuts may split a multi-byte character, so ``kept``
    is binary. Very long texts are read whole; runs of one byte give many entries but no wrong result. Empty
    input: no rows. Other columns are not read.
    """
    body = text_of(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.hash(body).alias("text_hash"), body.alias("text"))
    spans = repeated_spans(rows, batches)
    by_doc = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    joined = rows.join(by_doc, _same_ref(rows, by_doc, ["doc_id", "text_hash"]), "left")
    cut = F.pandas_udf(_cut, CUT)(rows["text"], F.col("found.start"), F.col("found.end")).alias("cut")
    return joined.select(rows["doc_id"], F.octet_length(rows["text"].cast("binary")).cast("long").alias("n_bytes"), cut).select(
        "doc_id", "n_bytes", "cut.kept", "cut.spans"
    )
