"""Hierarchical packing of token sequences into windows of several lengths.

Each scan task packs what it reads, a block of about ``BLOCK_TOKENS`` tokens at a time, so neither texts
nor tokens are shuffled and a lost task is redone from its own input. Within a block:

1. whole windows of a document longer than the largest tier become sequences of their own; what is left
   is routed to the smallest tier that holds it;
2. from the longest tier down, each window starts with a document of its tier;
3. its gap is filled with whole documents of shorter tiers, largest first, then by cutting one;
4. sequences are dealt to step groups of near equal token counts, fullest first.

What is left at the end of a task (under one window) is cut at powers of two, so it needs no padding.
"""

import base64
import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (128, 256, 512, 1024)
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 64 * 1024
END_ID = 0
# A task numbers its sequences from its partition number times this.
_PER_TASK = 1 << 36

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("tier", pa.int64()),
        ("step_group", pa.int64()),
    ]
)
PIECES_DDL = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, tier long, step_group long"
)


def encoder(vocabulary: str | None = None):
    """text -> ids of the public 50k byte-level vocabulary.

    The tokenizers file and the rank file hold the same vocabulary and give the same ids (a test holds one
    against the other); the rank form is three times as fast. ``<|endoftext|>`` in a text is one id, as there.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    special = {"<|endoftext|>": len(ranks)}
    made = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: made.encode(text, allowed_special="all")


def pack_block(lengths, tiers=TIERS, carry=()):
    """Sequences, each a list of (document, start, length), of the documents in ``lengths``.

    ``carry`` holds (document, start, length) left by the block before. Returns (sequences, left): all
    sequences are as long as some tier; ``left`` holds pieces of under one largest window in all.
    """
    longest = tiers[-1]
    done, rests = [], [(n, doc, start) for doc, start, n in carry]
    for doc, n in enumerate(lengths):
        whole = n // longest * longest
        done.extend([(doc, start, longest)] for start in range(0, whole, longest))
        if n > whole:
            rests.append((n - whole, doc, whole))
    rests.sort()
    for below, tier in reversed(list(zip((0, *tiers[:-1]), tiers, strict=True))):
        # The shortest tier has nothing shorter to fill from; its documents go into long windows instead.
        size = tier if below else longest
        while rests and rests[-1][0] > below:
            if size < longest and len(done) and sum(r[0] for r in rests[-2:]) <= below:
                break
            n, doc, start = rests.pop()
            sequence, gap = [(doc, start, n)], size - n
            while gap and rests:
                at = bisect.bisect_right(rests, (gap, 1 << 62)) - 1
                n, doc, start = rests.pop(max(at, 0))
                taken = min(n, gap)
                sequence.append((doc, start, taken))
                gap -= taken
                if n > taken:
                    bisect.insort(rests, (n - taken, doc, start + taken))
            if gap:
                return done, sequence
            done.append(sequence)
    return done, []


def _powers(left):
    """Cut what is left into sequences whose lengths are powers of two."""
    total = sum(n for _, _, n in left)
    sequences, queue = [], list(left)
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        sequence = []
        while size:
            doc, start, n = queue.pop(0)
            taken = min(n, size)
            sequence.append((doc, start, taken))
            size -= taken
            if n > taken:
                queue.insert(0, (doc, start + taken, n - taken))
        sequences.append(sequence)
    return sequences


def step_groups(sizes, step_tokens=STEP_TOKENS):
    """The step group of each sequence: longest first, always to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    chosen = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, group = heapq.heappop(groups)
        chosen[i] = group
        heapq.heappush(groups, (tokens + sizes[i], group))
    return chosen, len(groups)


def _packer(tiers, block_tokens, step_tokens, vocabulary):
    def emit(sequences, held, numbers):
        sizes = [sum(n for _, _, n in s) for s in sequences]
        groups, used = step_groups(sizes, step_tokens)
        out = {name: [] for name in PIECES.names}
        for sequence, size, group in zip(sequences, sizes, groups, strict=True):
            offset = 0
            for doc, start, n in sequence:
                doc_id, ids = held[doc]
                row = (doc_id, start, n, ids[start : start + n].tobytes(), len(ids), numbers[0], offset, size, numbers[1] + group)
                for name, value in zip(PIECES.names, row, strict=True):
                    out[name].append(value)
                offset += n
            numbers[0] += 1
        numbers[1] += used
        return pa.RecordBatch.from_pydict(out, schema=PIECES)

    def run(batches):
        encode = encoder(vocabulary)
        first = TaskContext.get().partitionId() * _PER_TASK
        numbers, held, tokens, carry = [first, first], [], 0, []

        def flush(last):
            nonlocal held, tokens, carry
            fresh = [0] * len({d for d, _, _ in carry}) + [len(ids) for _, ids in held[len({d for d, _, _ in carry}) :]]
            sequences, carry = pack_block(fresh, tiers, carry)
            if last:
                sequences, carry = sequences + _powers(carry), []
            batch = emit(sequences, held, numbers)
            # Keep only the documents of the carried pieces, renumbered from 0.
            keep = {doc: i for i, doc in enumerate(dict.fromkeys(d for d, _, _ in carry))}
            held = [held[doc] for doc in keep]
            carry = [(keep[d], start, n) for d, start, n in carry]
            tokens = 0
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def pack(
    docs: DataFrame, doc_id="doc_id", text="text", tiers=TIERS, block_tokens=BLOCK_TOKENS, step_tokens=STEP_TOKENS, vocabulary=None
) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset, tier (tokens in the sequence), step_group.

    A document is its ids and the id 0; every id stands in exactly one piece. Null or empty text: the one id
    0. Null id: packed, with a null doc_id. Repeated rows: packed once for each row. Very long texts: cut
    into windows of the largest tier, whole texts are read. Empty input: no rows. Other columns are not read.
    ``tiers``: ascending powers of two. Sequence numbers depend on the scan's partitions, so give it a table
    that has been written, not a plan whose row order may change between two runs of a task.
    """
    if not all(t & (t - 1) == 0 for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_packer(tuple(tiers), block_tokens, step_tokens, vocabulary), PIECES_DDL)
