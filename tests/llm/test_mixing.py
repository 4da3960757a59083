import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def placed(blocks, units):
    """[source] by slot, from the phase and frame rows."""
    phase_rows, frame_rows = mixing.phases(blocks, units)
    seats = {(p, s, k): x for p, s, k, x in frame_rows}
    order = {}
    for phase, s, _, n, start, own, period in phase_rows:
        for k in range(n):
            slot = start + k // own * period + seats[phase, s, k % own]
            assert slot not in order
            order[slot] = (phase, s)
    assert sorted(order) == list(range(sum(blocks.values())))
    return [order[i] for i in range(len(order))]


@pytest.mark.parametrize("units", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 90, "b": 1, "c": 7, None: 2}, {"a": 1}, {f"s{i}": 1 + i * i for i in range(12)}])
def test_every_prefix_is_within_one_block(units):
    random.seed(len(units))
    blocks = {s: random.randrange(1, 300) for s in units}
    order, seen, left = placed(blocks, units), {}, dict(blocks)
    for n, (phase, s) in enumerate(order):
        if phase not in seen:
            live = [x for x, k in left.items() if k]
            seen[phase] = (n, {x: 0 for x in live}, sum(units[x] for x in live))
        first, counts, total = seen[phase]
        counts[s] += 1
        left[s] -= 1
        for x, count in counts.items():
            assert abs(count - units[x] * (n + 1 - first) / total) < 1
    assert not any(left.values())


def test_windows_of_a_frame():
    units = {"a": 7, "b": 4, "c": 2}
    for s, slots in mixing.frame(units).items():
        for k, slot in enumerate(slots):
            assert k * 13 // units[s] <= slot < -(-(k + 1) * 13 // units[s])


def table(docs_of, n=600):
    random.seed(5)
    return docs_of([(i, "x" * random.randrange(400), random.choice(["big"] * 6 + ["mid", "mid", "small", None])) for i in range(n)])


def test_schedule_places_every_document_and_keeps_shares(docs_of):
    docs = table(docs_of)
    weights = {"big": 2, "mid": 3, "small": 1, None: 1}
    rows = mixing.schedule(docs, weights, block_bytes=1000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(600))
    total, slots = {}, {}
    for r in sorted(rows, key=lambda r: (r.source or "", r.before)):
        assert r.before == total.get(r.source, 0) and r.block == r.before // 1000
        total[r.source] = r.before + r.bytes
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    first_end = min(-(-n // 1000) * 7 // weights[s] for s, n in total.items()) - 1
    for s, w in weights.items():
        begun = sum(r.bytes for r in rows if r.source == s and r.slot < first_end)
        assert abs(begun - w * first_end * 1000 / 7) <= 1000 + 2 * 416


def test_mixed_lays_rows_out_in_order(docs_of):
    docs = table(docs_of).withColumn("slot", F.lit("own")).withColumn("a.b", F.lit(1))
    slot = {r.doc_id: (r.slot, r.before) for r in mixing.schedule(docs, block_bytes=1000).collect()}
    out = mixing.mixed(docs, block_bytes=1000)
    assert out.columns == docs.columns
    got = [slot[r.doc_id] for r in out.collect()]
    assert len(got) == 600 and got == sorted(got)


def test_nulls_repeats_long_texts_and_no_rows(docs_of):
    docs = docs_of([(1, None, "a"), (None, "x", "a"), (None, "y", None), (2, "z", "b"), (2, "z", "b"), (3, "w" * 300_000, "b"), (4, "v", "b")])
    assert mixing.schedule(docs).count() == 6
    out = mixing.mixed(docs).collect()
    assert sorted(str(r.doc_id) + str(r.source) for r in out) == sorted(str(r.doc_id) + str(r.source) for r in docs.collect())
    assert mixing.schedule(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    with pytest.raises(KeyError):
        mixing.schedule(docs, {"a": 1})


def test_tempered_weights():
    assert mixing.tempered({"a": 10_000, "b": 100, "c": 0}, units=110) == {"a": 99, "b": 10, "c": 1}


def plain_slots(blocks, units):
    """{(source, block): slot} by a whole frame for each phase."""
    left, done, start, slots = dict(blocks), dict.fromkeys(blocks, 0), 0, {}
    while left:
        common = mixing.math.gcd(*(units[s] for s in left))
        own = {s: units[s] // common for s in left}
        period, shape = sum(own.values()), mixing.frame(own)
        at = lambda s, k: k // own[s] * period + shape[s][k % own[s]]  # noqa: B023, E731
        length = min(at(s, n - 1) + 1 for s, n in left.items())
        for s in list(left):
            k = 0
            while k < left[s] and at(s, k) < length:
                slots[s, done[s] + k] = start + at(s, k)
                k += 1
            done[s] += k
            left[s] -= k
            if not left[s]:
                del left[s]
        start += length
    return slots


def test_phases_equal_whole_frames():
    random.seed(11)
    for case in range(60):
        n = random.randrange(1, 25)
        units = {(None if i == 3 else f"s{i}"): random.choice([1, 1, 2, 3, 6, 40]) for i in range(n)}
        blocks = {s: random.choice([1, 1, 2, 5, random.randrange(1, 400)]) for s in units}
        phase_rows, frame_rows = mixing.phases(blocks, units)
        seats = {(p, s, k): x for p, s, k, x in frame_rows}
        got = {(s, first + k): start + k // own * period + seats[p, s, k % own] for p, s, first, n, start, own, period in phase_rows for k in range(n)}
        assert got == plain_slots(blocks, units), case
        assert len(frame_rows) <= sum(blocks.values()) and len(phase_rows) <= sum(blocks.values())


def test_thousands_of_sources_and_a_hot_one(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "WRITE_ENTRIES", 1000)
    docs = docs_of([(i, "x" * 100, f"site{i}") for i in range(3000)] + [(3000 + i, "y" * 300, "hot") for i in range(2000)])
    rows = mixing.schedule(docs, block_bytes=316).collect()
    assert sorted(r.doc_id for r in rows) == list(range(5000)) and sorted(r.slot for r in rows) == list(range(5000))


def test_thousands_of_sources_keep_their_weights_apart():
    sizes = {f"s{i:04d}": 1 + i * 815 // 3000 for i in range(3000)}
    units, total = mixing.tempered(sizes), sum(n**0.5 for n in sizes.values())
    whole = sum(units.values())
    for s, n in sizes.items():
        asked = n**0.5 / total
        if asked >= 1 / len(sizes):
            assert abs(units[s] / whole - asked) <= asked / mixing.UNITS_PER_SOURCE, s
    assert units["s2999"] > 20 * units["s0000"]
