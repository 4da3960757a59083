import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

CORPUS = "/root/testdata/sf0.001/documents.parquet"


def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def held(pieces, texts):
    """Every id of every document in one piece, gapless sequences; returns sequence lengths."""
    docs, sequences = {}, {}
    for p in pieces:
        ids = [int.from_bytes(p.ids[i : i + 4], "little") for i in range(0, len(p.ids), 4)]
        assert len(ids) == p.length > 0
        docs.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.tier, p.step_group))
    encode = reference()
    assert set(docs) == set(texts)
    for d, parts in docs.items():
        whole = [i for _, ids, _ in sorted(parts) for i in ids]
        assert whole == encode(texts[d]) and {n for _, _, n in parts} == {len(whole)}
        assert [s for s, _, _ in sorted(parts)] == [sum(len(ids) for _, ids, _ in sorted(parts)[:k]) for k in range(len(parts))]
    for parts in sequences.values():
        parts.sort()
        assert [o for o, *_ in parts] == [sum(n for _, n, *_ in parts[:k]) for k in range(len(parts))]
        assert len({(t, g) for *_, t, g in parts}) == 1 and parts[0][2] == sum(n for _, n, *_ in parts)
    return [sum(n for _, n, *_ in parts) for parts in sequences.values()]


def test_every_id_once_and_no_padding(spark):
    docs = spark.read.parquet(CORPUS)
    lengths = held(packing.pack(docs, block_tokens=20_000).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert all(n <= 1024 and n & (n - 1) == 0 for n in lengths)
    assert sum(n == 1024 for n in lengths) > 0.5 * len(lengths) or sum(n for n in lengths if n >= 128) > 0.99 * sum(lengths)


def test_special_text_is_encoded_as_the_tokenizers_file_does():
    encode, plain = packing.encoder(), reference()
    for text in ["", "<|endoftext|>", "a <|endoftext|>b", "café \U0001f600 �", " \n\t\x0b ", "'s 'S don't", "中文" * 50, "a" * 3000]:
        assert [*encode(text), 0] == plain(text)


def test_nulls_empty_long_and_repeated_rows(docs_of):
    long = "lorem ipsum dolor " * 4000
    docs = docs_of([(1, None), (2, ""), (3, long), (4, "short"), (5, long)])
    held(packing.pack(docs.coalesce(1)).collect(), {1: "", 2: "", 3: long, 4: "short", 5: long})
    again = packing.pack(docs_of([(7, "same"), (7, "same"), (None, "x")])).collect()
    assert sorted((r.doc_id or 0, r.start) for r in again if r.start == 0) == [(0, 0), (7, 0), (7, 0)]
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [[1], [1024], [1025] * 3, [700] * 50, [5] * 500, [129, 500, 1023, 2, 4096, 64] * 30])
def test_blocks_leave_less_than_a_window(lengths):
    sequences, left = packing.pack_block(lengths)
    sizes = [sum(n for *_, n in s) for s in sequences]
    assert all(s in packing.TIERS for s in sizes) and sum(n for *_, n in left) < 1024
    assert sum(sizes) + sum(n for *_, n in left) == sum(lengths)
    chosen, groups = packing.step_groups(sizes, 8192)
    loads = [sum(s for s, g in zip(sizes, chosen) if g == k) for k in range(groups)]
    assert max(loads) - min(loads) <= 1024


def test_tiers_are_checked(docs_of):
    with pytest.raises(ValueError):
        packing.pack(docs_of([(1, "a")]), tiers=(100, 1024))
