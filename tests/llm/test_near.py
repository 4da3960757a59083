import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near
from tidemark.llm.components import components
from tidemark.llm.superminhash import bands, mixed, signatures


def expected(rows, width, similarity):
    sets = [near.shingle_set(near.tokens(t or ""), width) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    smallest = {}
    for (d, _), g in zip(rows, group):
        smallest[g] = min(smallest.get(g, d), d)
    return {d: (len(s), smallest[g]) for (d, _), s, g in zip(rows, sets, group)}


def corpus():
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefg", k=3))
    texts = [None, "", "  \n", "one", "One", "two words", "TWO  words", "é É", "é é"]
    for size, copies, edits in ((60, 25, 4), (60, 60, 16), (200, 10, 12), (12, 12, 2), (5, 4, 1)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(random.randrange(edits + 1)):
                own[random.randrange(size)] = word()
            texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(random.randrange(40))) for _ in range(60)] + texts[20:30]
    ids = list(range(100, 100 + len(texts)))
    random.shuffle(ids)
    return list(zip(ids, texts))


def test_groups_are_those_of_all_pairs(docs_of):
    rows = corpus()
    for width in (2, 5):
        got = near.link_groups(docs_of(rows), width=width).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(rows, width, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_buckets_use_bounds_and_lose_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(near, "LED_MEMBERS", 2)
    rows = corpus()
    got = near.link_groups(docs_of(rows), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(rows, 2, 80)


def test_nulls_repeats_long_texts_clashing_names_and_no_rows(docs_of):
    long = " ".join(map(str, range(30_000)))
    docs = docs_of([(None, "a b c"), (4, "A b c"), (4, "A b c"), (None, None), (7, ""), (8, long), (9, long + " end"), (None, "only here")])
    docs = docs.withColumn("node", F.lit(1)).withColumn("text_hash", F.lit("x")).withColumn("root", F.lit(2))
    got = near.link_groups(docs, width=2).collect()
    found = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles, r.kept) for r in got)
    assert found == [
        (0, 0, 0, True), (0, 0, 1, True), (0, 4, 2, False), (4, 4, 2, True), (4, 4, 2, True), (7, 7, 0, True), (8, 8, 29_999, True), (9, 8, 30_000, False),
    ]
    assert near.link_groups(docs.limit(0)).count() == 0


def plain_signature(elements, slots):
    """One element after another, each with a whole permutation."""
    best = [None] * slots
    for e in elements:
        places = list(range(slots))
        for j in range(slots):
            with np.errstate(over="ignore"):
                drawn = int(mixed(np.array([e], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1))[0])
            k = j + ((drawn & 0xFFFFFFFF) * (slots - j) >> 32)
            places[j], places[k] = places[k], places[j]
            value = (j << 32) | (drawn >> 32)
            if best[places[j]] is None or value < best[places[j]]:
                best[places[j]] = value
    return best


def test_signatures_match_the_plain_algorithm():
    random.seed(6)
    sets = [[random.getrandbits(64) for _ in range(n)] for n in (1, 2, 7, 64, 300)]
    elements = np.array([e for s in sets for e in s], dtype=np.uint64)
    got = signatures(elements, np.repeat(np.arange(5), [len(s) for s in sets]), 5, 64)
    assert got.tolist() == [plain_signature(s, 64) for s in sets]


def test_signatures_estimate_similarity_and_bands_separate_positions():
    random.seed(7)
    a, b = list(range(1000)), list(range(200, 1200))
    both = mixed(np.array(a + b, dtype=np.uint64) + np.uint64(1))
    got = signatures(both, np.repeat([0, 1], 1000), 2, 240)
    assert abs((got[0] == got[1]).mean() - 2 / 3) < 0.1
    assert len(np.unique(bands(np.zeros((1, 12), dtype=np.uint64), 4))) == 4


def test_components_of_chains_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(500)] + [(2001, 2002), (2002, 2003), (2003, 2001), (9, 9)]
    random.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1500), 1000), **dict.fromkeys((2001, 2002, 2003), 2001)}
