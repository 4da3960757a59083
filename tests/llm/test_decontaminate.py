import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D
from tidemark.llm.queries import op11_decontaminate

ITEMS = "item_id long, text string"


def _words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _expected(docs, items, window=10):
    """(doc_id, words, hit words, item ids) by trying every window everywhere."""
    grams = {}
    for item, text in items:
        ws = _words(text)
        n = min(window, len(ws))
        for p in range(len(ws) - n + 1 if n else 0):
            grams.setdefault(tuple(ws[p : p + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        ws, hit, found = _words(text), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(ws) - n + 1):
                held = grams.get(tuple(ws[p : p + n]))
                if held:
                    hit.update(range(p, p + n))
                    found |= held
        found = sorted({str(i) for i in found if i is not None})
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def _got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("part_words", [D.PART_WORDS, 60])
def test_few_words_in_every_arrangement_equal_brute_force(spark, docs_of, part_words):
    """Three words only, so that runs repeat, overlap and branch as much as they can."""
    dice = random.Random(part_words)
    text = lambda most: " ".join(dice.choice("abc") for _ in range(dice.randint(0, most)))
    items = [(i, text(25)) for i in range(14)] + [(3, "a b c a"), (99, text(3)), (None, text(12)), (100, None)]
    docs = [(i, text(60)) for i in range(120)]
    got = D.report(docs_of(docs), spark.createDataFrame(items, ITEMS), part_words=part_words)
    assert _got(got) == _expected(docs, items)


def test_the_longest_match_is_tracked_and_no_run_spans_two_items():
    ws = [b"%d" % n for n in range(40)]
    auto = D.automaton([("x", ws[:15]), ("y", ws[15:30])])
    runs, items = D.walk(auto, ws[:30])
    assert runs == [[0, 30, 15]] and items == {"x", "y"}
    assert D.walk(auto, ws[8:22])[0] == []  # 7 words of one and 7 of the other
    assert D.walk(auto, ws[30:] + ws[3:14])[0] == [[10, 21, 11]]


def test_words_are_cut_as_the_rule_says():
    text = "It's 5× ÉTÉ-a\x7fb_ c\U0001f600 \x00X"
    assert [w.decode() for w in D.words_of(text)] == _words(text)


def test_removal_cuts_long_runs_and_marks_covered_documents(spark, docs_of):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage), (2, "short item é")], ITEMS)
    docs = docs_of([(1, f"Intro é, {passage.upper()}! End of it " + "x " * 40), (2, passage), (3, "a Short, item É b"), (4, None), (5, "clean")])
    docs = docs.withColumns({"found": F.lit(1), "spans": F.lit(2), "_cut": F.lit(3)})
    rows = {r.doc_id: r for r in D.remove(docs, items).collect()}
    assert rows[1].text.startswith("Intro é, ! End of it x") and not rows[1].dropped and rows[1].found.longest == 12
    span = rows[1].spans[0]
    assert (span.start, span.end) == (9, 9 + len(passage)) and rows[1]._cut == 3
    assert rows[2].text == "" and rows[2].dropped and rows[2].found["items"] == ["1"]
    # É is no A-Z, so the third word differs; the whole short item is not there
    assert rows[3].text == "a Short, item É b" and rows[3].found.n_hit == 0
    assert rows[4].text is None and rows[4].found.n_words == 0 and not rows[4].dropped
    strict = {r.doc_id: r for r in D.remove(docs_of([(1, "a Short, item é b")]), items, max_run=0).collect()}
    assert strict[1].text == "a  b" and strict[1].found.n_hit == 3


def test_long_items_are_cut_without_losing_a_window(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "PIECE_WORDS", 7)
    words = [f"w{i}" for i in range(100)]
    items = [(1, " ".join(words))]
    docs = [(i, " ".join(words[i : i + 10])) for i in range(91)] + [(200, " ".join(words)), (201, " ".join(words[:9]))]
    got = D.report(docs_of(docs), spark.createDataFrame(items, ITEMS), part_words=20)
    assert _got(got) == _expected(docs, items)


def test_nulls_repeats_long_texts_and_empty_tables(spark, docs_of):
    items = [(1, "k l m"), (1, "n o"), (2, ""), (3, None), (None, "q r"), (10, "n o"), (9, "n o")]
    docs = [(1, "k l m"), (1, "k l m"), (None, "N o"), (2, "q r"), (3, ""), (4, None), (5, "x " * 600_000 + "k l m"), (6, "--- ,,")]
    table = spark.createDataFrame(items, ITEMS)
    assert _got(D.report(docs_of(docs), table)) == _expected(docs, items)
    assert D.report(docs_of([]), table).count() == 0
    assert _got(D.report(docs_of(docs), table.limit(0))) == _expected(docs, [])


def test_the_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = op11_decontaminate(spark, sf)
    assert _got(got) == _expected(docs, items) and got.filter("contaminated").count() > 0
