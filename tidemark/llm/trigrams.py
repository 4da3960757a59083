"""A trigram index over documents, and Boolean trigram queries derived from regular expressions.

The index is written once, in shards: consecutive documents of an Arrow batch of the scan, up to ``SHARD_BYTES``
of text, with the documents among them that contain each trigram. No text and no posting is shuffled, and a
shard is bounded in documents and in bytes, whatever the corpus. Trigrams are of UTF-8 bytes with A-Z folded to a-z, so one index serves
patterns of either case (a superset; candidates are verified).
"""

import re
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANY = ("any",)
# A pattern part that stands for more strings than this is treated as unknown.
MAX_STRINGS = 64
# Text of a shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20

SHARD_DDL = "shard long, trigram int, n_docs int, postings binary, doc_ids binary"
_SHARD = pa.schema([("shard", pa.int64()), ("trigram", pa.int32()), ("n_docs", pa.int32()), ("postings", pa.binary()), ("doc_ids", pa.binary())])
# The row of a shard that lists its documents, and the trigram number above all real ones.
DOCS = 1 << 24

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32


def trigram_codes(data: bytes) -> np.ndarray:
    """The code of the trigram at each byte."""
    b = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]


# --- Boolean queries -------------------------------------------------------------------------------


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _either(parts):
    parts = list(dict.fromkeys(parts))
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _contains(strings):
    """That a text contains one of the strings."""
    each = [_all([int(c) for c in trigram_codes(s.encode())]) if len(s.encode()) >= 3 else ANY for s in strings]
    return _either(each)


def _members(items):
    """The characters of a class, or None if they are negated or too many."""
    chars = []
    for kind, value in items:
        if kind is op.LITERAL:
            chars.append(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < 10:
            chars.extend(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return chars if len(chars) <= 10 else None


def _exact(kind, value):
    """All strings an item can match, if they are few, else None."""
    if kind is op.LITERAL:
        return {chr(value)}
    if kind is op.IN:
        chars = _members(value)
        return None if chars is None else set(chars)
    if kind is op.AT:
        return {""}
    if kind is op.SUBPATTERN:
        return _exact_sequence(value[3])
    if kind is op.BRANCH:
        options = [_exact_sequence(x) for x in value[1]]
        return None if None in options else set().union(*options)
    if kind is op.MAX_REPEAT and value[1] <= 3:
        one = _exact_sequence(value[2])
        if one is None:
            return None
        strings, out = {""}, set()
        for n in range(value[1] + 1):
            out |= strings if n >= value[0] else set()
            strings = {a + b for a in strings for b in one}
        return out if len(out) <= MAX_STRINGS else None
    return None


def _exact_sequence(items):
    strings = {""}
    for kind, value in items:
        more = _exact(kind, value)
        if more is None or len(strings) * len(more) > MAX_STRINGS:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _query(items):
    """What every match of the sequence contains: runs of known strings, and the queries of unknown parts."""
    parts, strings = [], {""}
    for kind, value in items:
        more = _exact(kind, value)
        if more is not None and len(strings) * len(more) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in more}
            continue
        parts.append(_contains(strings))
        strings = more or {""}
        if more is None and kind is op.SUBPATTERN:
            parts.append(_query(value[3]))
        elif more is None and kind is op.BRANCH:
            parts.append(_either([_query(x) for x in value[1]]))
        elif more is None and kind is op.MAX_REPEAT and value[0] > 0:
            parts.append(_query(value[2]))
    return _all([*parts, _contains(strings)])


def trigram_query(pattern: str):
    """A Boolean query that every text with a match of ``pattern`` satisfies: a trigram code, ("and", ...),
    ("or", ...), or ANY if the pattern has no mandatory trigram. Patterns must not fold case beyond ASCII."""
    return _query(parser.parse(pattern, re.ASCII))


def trigrams_in(query) -> set:
    if isinstance(query, int):
        return {query}
    return set().union(*(trigrams_in(q) for q in query[1:])) if query != ANY else set()


# --- the index -------------------------------------------------------------------------------------


def _pack_postings(members: np.ndarray, n: int) -> bytes:
    """Sorted document numbers of a shard of ``n``: 4 bytes each, or one bit per document if that is shorter."""
    if len(members) * 32 <= n:
        return b"\0" + members.astype("<u4").tobytes()
    bits = np.zeros(n, dtype=bool)
    bits[members] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpack_postings(data: bytes, n: int) -> np.ndarray:
    """As one flag per document."""
    if data[0]:
        return np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1), count=n).astype(bool)
    bits = np.zeros(n, dtype=bool)
    bits[np.frombuffer(data, dtype="<u4", offset=1)] = True
    return bits


def _slices(batch):
    """The batch in runs of rows with up to SHARD_BYTES of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > SHARD_BYTES:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def _index(batches):
    first = TaskContext.get().partitionId() << 24
    slices = (part for batch in batches for part in _slices(batch))
    for shard, part in enumerate(slices, first):
        ids, texts = part.column(0), part.column(1)
        pairs = []
        for number, text in enumerate(texts):
            data = (text.as_py() or "").encode()
            if len(data) >= 3:
                codes = np.unique(trigram_codes(data)).astype("<u8")
                pairs.append((codes << np.uint64(32)) | np.uint64(number))
        together = np.concatenate(pairs) if pairs else np.zeros(0, "<u8")
        del pairs
        together.sort()
        halves = together.view("<u4").reshape(-1, 2)
        members, codes = halves[:, 0], halves[:, 1]
        n = len(ids)
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        ends = np.append(starts[1:], len(codes))
        listed = ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        postings = [_pack_postings(members[a:b], n) for a, b in zip(starts, ends, strict=True)]
        rest = len(postings)
        columns = (
            [shard] * (rest + 1), np.append(codes[starts], DOCS).astype(np.int32), [n] * (rest + 1),
            [*postings, None], [*[None] * rest, listed],
        )
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SHARD, strict=True)], schema=_SHARD)


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of ``docs`` to ``path``. Rows with a null id are left out; null text has no trigram."""
    rows = docs.filter(F.col(f"`{doc_id}`").isNotNull()).select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    shards = rows.mapInArrow(_index, SHARD_DDL)
    shards.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(SHARD_DDL).parquet(path)
