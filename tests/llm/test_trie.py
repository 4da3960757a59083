import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie
from tidemark.llm.queries import op13_prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def _nodes(sequences):
    """Every node by the plain definition. sequences: conv_id -> list of (role, text)."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, ids in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(ids) if len(sequences[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        seal = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(ids), len(prefix), parent, len(ids), len(children), len(leaves), saved, seal))
    return sorted(map(repr, out))


def _rebuilt(rows):
    """Rows without equal turns in one conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    return out


def _got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def _tables(spark, sequences):
    rows = [(c, d, f"{r}:{t}", len(t.encode())) for c, ts in sequences.items() for d, (r, t) in enumerate(ts, 1)]
    seq = spark.createDataFrame(rows, "conv_id long, d long, name string, bytes long")
    return seq, spark.createDataFrame([(c, len(ts)) for c, ts in sequences.items()], "conv_id long, length long")


@pytest.mark.parametrize("longest", [1, 2, 9, 33])
def test_random_sequences_of_many_depths_equal_brute_force(spark, longest):
    """Two kinds of turns, so that prefixes are shared at every depth and end anywhere."""
    dice = random.Random(longest)
    sequences = {}
    for c in dice.sample(range(1000), 40):
        again = sequences[dice.choice(list(sequences))] if sequences and dice.random() < 0.6 else []
        again = again[: dice.randint(0, len(again))]
        fresh = [("u", dice.choice(["a", "éé"])) for _ in range(dice.randint(0, longest - len(again)))]
        sequences[c] = again + fresh
    sequences[2000] = sequences[2001] = [("u", "é")] * longest
    assert _got(trie.build(*_tables(spark, sequences))) == _nodes(sequences)


def test_rebuilt_conversations_equal_brute_force(spark):
    dice = random.Random(5)
    rows = [(c, t, dice.choice("us"), f"{dice.choice('ab')}{'x' * t}") for c in range(60) if c % 11 for t in range(dice.randint(1, 12))]
    dice.shuffle(rows)
    table = spark.createDataFrame(rows, TURNS)
    assert _got(trie.prefix_trie(table)) == _nodes(_rebuilt(rows))


def test_nulls_repeats_long_texts_clashing_names_and_no_rows(spark):
    rows = [
        (5, None, "u", "first"), (5, 3, None, "c"), (5, 1, "a", None), (6, 0, "u", "y" * 300_000), (6, 1, "u", "z"),
        (None, 0, "u", "nobody"), (7, 0, None, None), (8, 2, "u", ""), (9, -1, "x", "minus"),
    ]
    table = spark.createDataFrame(rows, TURNS)
    clash = table.withColumns({"d": F.lit(1), "name": F.lit("x"), "pos": F.lit(2), "bytes": F.lit(3)})
    assert _got(trie.prefix_trie(clash)) == _nodes(_rebuilt(rows))
    assert trie.prefix_trie(table.limit(0)).count() == 0
    again = trie.prefix_trie(table.unionByName(table.filter("conv_id = 9")))
    # a repeated row is a turn like others, so 9 has two turns before its head is cut
    assert _got(again) == _nodes(_rebuilt([*rows, (9, -1, "x", "minus")]))


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(0, 1, "u", t) for t in "abcdefghijkl"] + [(1, 1, "u", t) for t in "lkjihgfedcba"]
    one = _got(trie.prefix_trie(spark.createDataFrame(rows, TURNS)))
    assert one == _got(trie.prefix_trie(spark.createDataFrame(rows[::-1], TURNS).repartition(5)))


def test_conversations_left_without_turns_end_at_the_root(spark):
    gone = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1]
    rows = [(c, 0, "u", f"t{c}") for c in gone]
    assert _got(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == _nodes({c: [] for c in gone})


def test_the_query_on_given_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(op13_prefix_trie(spark, sf)) == _nodes(_rebuilt(rows))
