"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised test items go into one suffix automaton: its states are the sets of places at which a run of words
occurs, over all items, and one walk over a document's words gives, at every word, the longest run ending there that
occurs in any item. Runs of at least a window's length are hits; which items they touch is read off the state.

A document is one walk, whole, whatever its length; the automaton is what is broadcast, so its size is bounded:
items are dealt to parts of at most PART_WORDS words, each with an automaton of its own, built in a task. As a rule
there is one part. With more, the documents are walked once for each, and what was found is written in between.
"""

import math
import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, text_of
from tidemark.plans.workspace import settle

WINDOW = 10
# An automaton has at most two states and three transitions a word; a part's takes about 150 MB in Python.
PART_WORDS = 250_000
# A longer item is cut into pieces of so many words; neighbours share all but one word of a window.
PIECE_WORDS = 20_000
# Limits of the operator: the longest run of words that may stay, the share of hit words above which a document goes.
MAX_RUN = WINDOW - 1
MAX_COVERAGE = 0.5

# Words are runs of digits, a-z and non-ASCII characters, after lower-casing A-Z. In UTF-8 every byte of a
# non-ASCII character lies above 0x7F, so the rule holds byte by byte.
_KEPT = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if _KEPT.match(bytes([b])) else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

FOUND = "n_words long, n_hit long, longest long, runs array<struct<start:int,end:int,longest:int>>, items array<string>"


def words_of(text: str) -> list[bytes]:
    """The words of a text, normalised."""
    return text.encode().translate(_PLAIN).split()


class Automaton(NamedTuple):
    """A suffix automaton ready to be walked.

    ``step[state * n_ids + word id]`` is the next state. ``short[state]``: lengths and items of whole items shorter than a
    window that are suffixes of the state's run. ``top[state]``: the state of its last ``window`` words (-1 if it is
    shorter). ``at``: per such state the items that hold this window.
    """

    word_ids: dict
    step: dict
    link: list
    length: list
    top: list
    at: dict
    short: dict
    window: int


def automaton(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Automaton:
    """Build the automaton of (item id, words). Each item starts again at the root, so no run spans two items."""
    word_ids = {}
    for _, ws in items:
        for w in ws:
            word_ids.setdefault(w, len(word_ids))
    n_ids = max(1, len(word_ids))
    nexts, link, length = [{}], [-1], [0]

    def state(edges, longest, suffix):
        nexts.append(edges)
        length.append(longest)
        link.append(suffix)
        return len(nexts) - 1

    def split(p, q, w):
        """The part of ``q`` that ends an occurrence of ``p``'s run and ``w``, as a state of its own."""
        copy = state(dict(nexts[q]), length[p] + 1, link[q])
        link[q] = copy
        while p != -1 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    ends = []
    for _, ws in items:
        last = 0
        for word in ws:
            w, p = word_ids[word], last
            q = nexts[p].get(w)
            if q is not None:  # the run is known from an earlier item
                last = q if length[q] == length[p] + 1 else split(p, q, w)
                continue
            last = state({}, length[p] + 1, 0)
            while p != -1 and w not in nexts[p]:
                nexts[p][w] = last
                p = link[p]
            if p != -1:
                q = nexts[p][w]
                link[last] = q if length[q] == length[p] + 1 else split(p, q, w)
        ends.append(last)

    # By length, so that a state comes after the one its link names.
    top, order = [-1] * len(link), sorted(range(len(link)), key=length.__getitem__)
    for s in order:
        if length[s] >= window:
            top[s] = s if length[link[s]] < window else top[link[s]]
    at, whole = {}, {}
    for (item, ws), end in zip(items, ends, strict=True):
        if 0 < len(ws) < window:
            whole.setdefault(end, {}).setdefault(len(ws), set()).add(item)
            continue
        s = 0
        for i, word in enumerate(ws):
            s = nexts[s][word_ids[word]]
            if i + 1 >= window:
                at.setdefault(top[s], set()).add(item)
    short = {}
    if whole:
        for s in order[1:]:
            mine = [(n, tuple(sorted(i for i in found if i is not None))) for n, found in sorted(whole.get(s, {}).items())]
            both = short.get(link[s], []) + mine
            if both:
                short[s] = both
    step = {s * n_ids + w: t for s, edges in enumerate(nexts) for w, t in edges.items()}
    listed = {s: tuple(sorted(i for i in found if i is not None)) for s, found in at.items()}
    return Automaton(word_ids, step, link, length, top, listed, short, window)


def walk(auto: Automaton, ws: list[bytes]):
    """(runs, items) of a document's words: hit runs [start, end, longest match in it), in order, and items that occur."""
    word_ids, step, link, length, top, at, short, window = auto
    get, known, n_ids = step.get, word_ids.get, max(1, len(word_ids))
    runs, tops, items = [], set(), set()
    s = matched = 0
    for i, word in enumerate(ws):
        w = known(word)
        if w is None:
            s = matched = 0
            continue
        t = get(s * n_ids + w)
        while t is None and s:
            s = link[s]
            matched = length[s]
            t = get(s * n_ids + w)
        if t is None:
            continue
        s, matched = t, matched + 1
        reach = 0
        if matched >= window:
            reach = matched
            tops.add(top[s])
        for n, found in short.get(s, ()):
            if n <= matched:
                items.update(found)
                reach = max(reach, n)
        if reach:
            start = i + 1 - reach
            while runs and runs[-1][0] >= start:
                reach = max(reach, runs.pop()[2])
            if runs and runs[-1][1] >= start:
                runs[-1][1], runs[-1][2] = i + 1, max(runs[-1][2], reach)
            else:
                runs.append([start, i + 1, reach])
    for t in tops:
        items.update(at[t])
    return runs, items


def _joined(runs, more):
    """Two ordered lists of runs as one, overlaps merged."""
    out = []
    for start, end, longest in sorted([*runs, *more]):
        if out and start <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], end), max(out[-1][2], longest)
        else:
            out.append([start, end, longest])
    return out


def _walker(shared):
    """A column function over (text, found so far) for the broadcast part."""

    def found(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        auto = pickle.loads(shared.value)
        for texts, runs_before, items_before in parts:
            rows = []
            for text, earlier, held in zip(texts, runs_before, items_before, strict=True):
                ws = words_of(text)
                runs, items = walk(auto, ws)
                if earlier is not None and len(earlier):
                    runs = _joined(runs, [[r["start"], r["end"], r["longest"]] for r in earlier])
                if held is not None:
                    items.update(held)
                told = [{"start": a, "end": b, "longest": n} for a, b, n in runs]
                hit = sum(b - a for a, b, _ in runs)
                rows.append((len(ws), hit, max((r[2] for r in runs), default=0), told, sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "longest", "runs", "items"])

    return F.pandas_udf(found, FOUND)


def _pieces(window):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                ws = words_of(text)
                # An item that fits is one piece; else each piece but the last is a whole step and the overlap.
                for first in range(0, max(1, len(ws) - window + 1), PIECE_WORDS):
                    piece = ws[first : first + PIECE_WORDS + window - 1]
                    if piece:
                        rows.append((item, b" ".join(piece), len(piece)))
            yield pd.DataFrame(rows, columns=["item", "words", "n"])

    return cut


def automata(items: DataFrame, item_id="item_id", text="text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """(part, automaton): the pickled automata of the items, each over at most ``part_words`` words or one piece."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), text_of(f"`{text}`").alias("text"))
    pieces = settle(rows.mapInPandas(_pieces(window), "item string, words binary, n long").distinct(), "items")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    parts = 1 if total <= part_words else math.ceil(2 * total / part_words)
    while True:
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("words", "item"), F.lit(parts)))
        sizes = dealt.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).filter((F.col("n") > part_words) & (F.col("k") > 1))
        if parts == 1 and total <= part_words or sizes.isEmpty():
            break
        parts *= 2

    def build(pdf):
        held = [(None if pd.isna(i) else i, bytes(w).split()) for i, w in zip(pdf["item"], pdf["words"], strict=True)]
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "automaton": [pickle.dumps(automaton(held, window), protocol=5)]})

    return settle(dealt.groupBy("part").applyInPandas(build, "part long, automaton binary"), "automata")


def find(docs: DataFrame, items: DataFrame, text="text", item_id="item_id", item_text="text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` and the column ``found`` (FOUND): words, hit words, the longest match, hit runs of words, items.

    A word is hit if it lies in a run of ``window`` words that some item holds, or in a whole item of fewer words. Rows
    that share an item id are one item; items without an id hit, but are not listed.

    Null text, no words: nothing is hit. Null or wordless items match nothing. Repeated rows: each like the other. Very
    long texts are walked whole. No items, no documents: no hits, no rows. A column of docs named found is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "found"])
    built = automata(items, item_id, item_text, window, part_words)
    parts = [r.part for r in built.select("part").collect()]  # a number for each part_words words of the benchmark
    body = text_of(f"`{text}`")
    none = F.lit(None).cast("array<struct<start:int,end:int,longest:int>>"), F.lit(None).cast("array<string>")
    for n, part in enumerate(sorted(parts) or [None]):
        one = built.filter(F.col("part") == part).select("automaton").first()
        shared = docs.sparkSession.sparkContext.broadcast(bytes(one.automaton) if one else pickle.dumps(automaton([], window)))
        before = (F.col("found.runs"), F.col("found.items")) if n else none
        docs = docs.withColumn("found", _walker(shared)(body, *before))
        if len(parts) > 1:
            docs = settle(docs, "walked")
            shared.unpersist()
    return docs


def _cut(max_run):
    def cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        kept, spans = [], []
        for text, found in zip(texts, runs, strict=True):
            gone = [] if found is None else [(r["start"], r["end"]) for r in found if r["longest"] > max_run]
            if not gone:
                kept.append(text)
                spans.append([])
                continue
            data = text.encode()
            places = [m.span() for m in _WORD.finditer(data.translate(_PLAIN))]
            out, told, at = [], [], 0
            for first, last in gone:
                start, end = places[first][0], places[last - 1][1]
                out.append(data[at:start])
                told.append({"start": len(data[:start].decode()), "end": len(data[:end].decode())})
                at = end
            out.append(data[at:])
            kept.append(b"".join(out).decode())
            spans.append(told)
        return pd.DataFrame({"kept": kept, "spans": spans})

    return F.pandas_udf(cut, "kept string, spans array<struct<start:int,end:int>>")


def remove(docs: DataFrame, items: DataFrame, text="text", max_run: int = MAX_RUN, max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """``docs`` without benchmark passages: ``text`` without the runs whose longest match exceeds ``max_run`` words,
    plus found, spans (removed, code points, end exclusive) and dropped (more than ``max_coverage`` of the words are hit).

    Dropped documents are marked, not filtered. A text without hits stays as it is, a null text null. See :func:`find`.
    """
    found = find(docs, items, text=text, **options)
    cut = free_name(found, "_cut")
    found = found.withColumn(cut, _cut(max_run)(text_of(f"`{text}`"), F.col("found.runs")))
    taken = {"found", "spans", "dropped", cut.lower()}
    rest = [c for c in found.columns if c.lower() not in taken]
    body = F.when(F.size(f"{cut}.spans") > 0, F.col(f"{cut}.kept")).otherwise(F.col(f"`{text}`"))
    return found.select(
        *[body.alias(c) if c == text else F.col(f"`{c}`") for c in rest],
        "found",
        F.col(f"{cut}.spans").alias("spans"),
        ((F.col("found.n_words") > 0) & (F.col("found.n_hit") > F.col("found.n_words") * max_coverage)).alias("dropped"),
    )


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, how many items occur and the digest of their ids."""
    found = find(docs.select("doc_id", "text"), items, **options)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )
