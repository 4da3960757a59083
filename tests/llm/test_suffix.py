import random

import numpy as np

from tidemark.llm import suffix


def expected(texts):
    where = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for p in range(len(b) - suffix.LENGTH + 1):
            where.setdefault(b[p : p + suffix.LENGTH], []).append((d, p))
    masks = [np.zeros(len(b) + 1, dtype=bool) for b in data]
    for places in where.values():
        if len(places) > 1:
            for d, p in places:
                masks[d][p : p + suffix.LENGTH] = True
    out = []
    for b, m in zip(data, masks):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], m]).astype(int)))
        out.append((bytes(x for x, gone in zip(b, m) if not gone), [tuple(map(int, e)) for e in edges.reshape(-1, 2)]))
    return out


def noise(n):
    return "".join(random.choices("abcdefghij \n", k=n))


def texts():
    random.seed(9)
    passage, other = noise(900), noise(650)
    out = [noise(random.randrange(1500)) + passage[random.randrange(400) :] + noise(random.randrange(300)) for _ in range(30)]
    out += [noise(50) + other + noise(20) + other + noise(70), passage[:401], passage[:400], passage[:399], other[100:500] + noise(1)]
    base = noise(3000)
    for _ in range(25):  # near copies: edits everywhere
        edited = list(base)
        for _ in range(random.randrange(6)):
            edited[random.randrange(3000)] = "Z"
        out.append("".join(edited))
    out += ["a" * 1200, "b" + "a" * 399 + "c", "ab" * 700, "é" * 300 + "x", "é" * 300 + "y", base, base, None, "", "tiny"]
    return out


def test_removes_exactly_what_a_full_comparison_removes(docs_of):
    rows = texts()
    got = {r.doc_id: r for r in suffix.remove_repeats(docs_of(list(enumerate(rows)))).collect()}
    for i, (kept, spans) in enumerate(expected(rows)):
        assert bytes(got[i].kept) == kept, i
        assert [tuple(s) for s in got[i].spans] == spans, i
        assert got[i].n_bytes == len((rows[i] or "").encode())


def test_number_of_batches_does_not_change_the_result(docs_of):
    docs = docs_of(list(enumerate(texts()[20:50])))
    one, five = ({r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(docs, batches=b).collect()} for b in (1, 5))
    assert one == five


def test_levels_merge_in_pairs(spark, docs_of, folder):
    rows = docs_of([(i, noise(2000)) for i in range(7)]).selectExpr("doc_id", "hash(text) AS text_hash", "text")
    family = suffix.SuffixFamily(spark, folder)
    for i in range(7):
        family.add(rows.filter(f"doc_id = {i}").mapInArrow(suffix._entries, suffix.ENTRY))
        assert sorted(family.levels) == [b for b in range(3) if (i + 1) >> b & 1]
    assert family.entries().count() == rows.mapInArrow(suffix._entries, suffix.ENTRY).count()
    assert family.add(rows.filter("doc_id = 3").mapInArrow(suffix._entries, suffix.ENTRY)).count() > 10


def test_every_string_has_one_anchor():
    random.seed(4)
    for data in (noise(1000).encode(), b"a" * 700, noise(400).encode()):
        entries = suffix.anchors(data)
        starts = [p for _, lo, hi in entries for p in range(lo, hi + 1)]
        assert starts == list(range(len(data) - suffix.LENGTH + 1))
        assert all(0 <= at - hi and at - lo < suffix.WINDOW for at, lo, hi in entries)
    assert len(suffix.anchors(b"x" * 399)) == 0


def test_null_ids_repeated_rows_and_no_rows(docs_of):
    text = noise(600)
    docs = docs_of([(None, text), (5, noise(600)), (6, text[:450] + "?"), (7, noise(420)), (7, "short")])
    got = {(r.doc_id, r.n_bytes): len(r.kept) for r in suffix.remove_repeats(docs).collect()}
    assert got == {(None, 600): 150, (5, 600): 600, (6, 451): 1, (7, 420): 420, (7, 5): 5}
    twice = suffix.remove_repeats(docs_of([(1, text), (1, text)])).collect()
    assert [len(r.kept) for r in twice] == [0, 0]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
