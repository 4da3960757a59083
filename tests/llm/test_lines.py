import random

from pyspark.sql import functions as F

from tidemark.llm import lines


def expected(rows, min_sites):
    spread, first = {}, {}
    for doc, text, site in rows:
        for line in (text or "").split("\n"):
            t = line.strip(" \t\n\x0b\x0c\r")
            if t:
                spread.setdefault(t, set()).add(site)
                first[t] = min(first.get(t, doc), doc)
    gone = {t for t, s in spread.items() if len(s - {None}) >= min_sites}
    return {d: None if x is None else "\n".join(k for k in x.split("\n") if not ((t := k.strip()) in gone and first[t] != d)) for d, x, _ in rows}


def test_matches_an_exact_count_near_and_far_from_the_threshold(docs_of):
    random.seed(5)
    pool = [f"shared line number {i} here" for i in range(40)]
    rows = []
    for d in range(400):
        own = [f"own text of document {d}", "", " short", *random.sample(pool[: 1 + d % 40], min(3, 1 + d % 40))]
        rows.append((d, "\n".join(own), f"s{(d * 7) % (1 + d % 25)}"))
    got = {r.doc_id: r for r in lines.dedup_lines(docs_of(rows), min_sites=10).collect()}
    want = expected(rows, 10)
    assert {d: r.text for d, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) == sum(x.count("\n") - want[d].count("\n") for d, x, _ in rows) > 0


def test_near_the_threshold_counts_are_exact(spark):
    rows = [(f"line {n}", f"site {s}", n) for n in range(80, 121) for s in range(n)]
    df = spark.createDataFrame(rows, "line string, site string, doc_id long").select("doc_id", "site", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    assert sorted(r.first_doc for r in lines.spread_lines(df, 100).collect()) == list(range(100, 121))


def test_nulls_blank_lines_repeats_and_clashing_names(docs_of):
    shared = "the very same line"
    rows = [(i, f"{shared}\n\n  x{i}\t", f"s{i}") for i in range(12)] + [(None, shared, "s90"), (20, None, "s91"), (21, "", None), (22, f" {shared} ", None), (3, f"{shared}\n\n  x3\t", "s3")]
    docs = docs_of(rows).withColumn("_hit", F.lit(1)).withColumn("n_removed", F.lit("old")).withColumn("h1", F.lit(2))
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, set()).add(r.text)
    assert texts[0] == {f"{shared}\n\n  x0\t"} and texts[3] == {"\n  x3\t"}
    assert texts[None] == {""} and texts[20] == {None} and texts[21] == {""} and texts[22] == {""}
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_a_line_that_only_rows_without_an_id_carry_stays(docs_of):
    got = lines.dedup_lines(docs_of([(None, "one two three", f"s{i}") for i in range(12)]))
    assert {r.text for r in got.collect()} == {"one two three"}


def test_lines_of_one_word_and_without_spaces_are_judged_like_others(docs_of):
    """One word, a script that writes no spaces, and a line of a million characters."""
    short, unspaced, long = "Les.", "\u7248\u6743\u6240\u6709", "x" * 1_000_000
    rows = [(i, f"{short}\nown {i}\n{unspaced}" + (f"\n{long}" if i < 3 else ""), f"s{i}") for i in range(12)]
    got = {r.doc_id: r for r in lines.dedup_lines(docs_of(rows)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    assert all(got[i].text == f"own {i}" + (f"\n{long}" if i < 3 else "") and got[i].n_removed == 2 for i in range(1, 12))
