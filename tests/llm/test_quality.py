import random
import re

from pyspark.sql import functions as F

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


TEXTS = [
    None, "", " \n\t\n", "one", "a b c d e a b c d e a b c d e", "x\ny\nx\n\n\nx", "éè naïve wide \U0001f600 end. " * 3,
    "Home | About | Contact | Login\nA sentence that says something, with twelve or more words in it, ends here.\n" * 2,
    "ends without any mark and goes on for more than twelve words so it is no heading at all",
    "#$% *** &&& ||| <<< >>> ### $$$ %%% ***", " ".join(map(str, range(20_000))), "na " * 3000,
]


def test_counts_match_a_plain_count(docs_of):
    random.seed(3)
    texts = TEXTS + [" ".join(random.choice("ab") + random.choice(["", ",", "\n"]) for _ in range(random.randrange(60))) for _ in range(40)]
    got = {r.doc_id: r for r in quality.measure(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected(text), i
        assert not (r.base_failed and r.kept)


def test_lines_decide_the_rest(docs_of):
    good = "This line is a plain sentence with quite a few words in it."
    menu = "Home | About us | Products | Contact | Help"
    rows = [(1, f"{good}\n{menu}"), (2, f"{menu}\nNews | Sports | Weather | Money | Travel\n{good[:20]}."), (3, good + "\nAll rights reserved by the company.")]
    got = {r.doc_id: r for r in quality.measure(docs_of(rows)).collect()}
    assert got[1].kept and got[1].clean_text == good
    assert not got[2].base_failed and not got[2].kept
    assert got[3].kept and got[3].clean_text == good


def test_why_a_line_fails(spark):
    cases = {
        "login": "navigation", "a | b | c": "navigation", "We use: this site uses cookies.": "boilerplate", "12 34 -- 56 ++ 78 ==": "punctuation",
        "a# b$ c% d& e*": "punctuation", " ".join(["word"] * 13): "punctuation", " ".join(["word"] * 13) + ". ": None, "A heading": None,
    }
    df = spark.createDataFrame(list(cases.items()), "line string, why string")
    assert [r.line for r in df.filter(~quality.line_fails(F.col("line")).eqNullSafe(F.col("why"))).collect()] == []


def test_repeated_rows_clashing_names_and_no_rows(docs_of):
    docs = docs_of([(1, "a b"), (1, "a b"), (None, None)]).withColumn("kept", F.lit("x")).withColumn("_tokens", F.lit(1)).withColumn("a.b", F.lit(2))
    got = quality.measure(docs)
    assert got.count() == 3 and {"a.b", "_tokens", "kept"} <= set(got.columns)
    assert [r.kept for r in got.collect()] == [False] * 3
    assert quality.measure(docs.limit(0)).count() == 0


def test_lines_of_a_million_characters_of_each_kind(docs_of):
    """Separators, spaces, letters, symbols and closing marks, alone and between words."""
    n = 1_000_000
    lines = ["|" * n, " " * n, "a" * n, "#" * n, "." * n, "a|" * (n // 2), "ab " * (n // 3), "home" + " " * n, " " * n + "menu", "\u2022 x " * (n // 4)]
    got = {r.doc_id: r for r in quality.measure(docs_of(list(enumerate(lines)))).collect()}
    for i, line in enumerate(lines):
        words = WORD.findall(line)
        assert (got[i].n_words, got[i].word_chars) == (len(words), sum(map(len, words))), i
    assert [i for i, r in sorted(got.items()) if r.clean_text == ""] == [0, 3, 4, 5, 6, 7, 8, 9]


def test_menus_are_told_by_their_entries(spark):
    menu = {"a|b|c": True, "a|b": False, "|" * 3000: True, "x" * 40 + "|b|" + "y" * 40: True, "x" * 41 + "|b|c": False, "a|b|" + "y" * 41: False, "": False}
    df = spark.createDataFrame(list(menu.items()), "line string, menu boolean")
    assert df.filter(quality._separated(F.col("line")) != F.col("menu")).count() == 0
