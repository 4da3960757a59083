"""Line-first cleaning: judge each line, take failing lines out, reject documents that lose too much.

Only built-in column functions; one pass over the documents, no shuffle.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, free_name, has_word, let, text_of, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
# A document goes if more than this share of its word characters stood in failing lines.
MAX_LOST_PERCENT = 50

# What each rule looks for. All patterns mean the same to Java and RE2.
SYMBOL = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
NAVIGATION = r"^\s*(home|menu|login|log in|sign in|sign up|search|next|previous|back to top|skip to content|share|contact us|about us)\s*$"
SEPARATOR = r"[|>\x{BB}\x{2022}\x{B7}]"
# A menu: two separators or more, never this many other characters in a row.
UNSEPARATED = r"[^|>\x{BB}\x{2022}\x{B7}]{41}"
BOILERPLATE = (
    "accept cookies",
    "accept all cookies",
    "uses cookies",
    "enable javascript",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "lorem ipsum",
    "click here",
    "subscribe to our",
    "spdx-license-identifier",
    "licensed under the",
)
ENDS = ".!?:;,\u2026\u3002\uff01\uff1f)]\"'\u201d\u2019\u00bb"
LETTERS = r"[^\p{L}]"
# A line also fails if it has more than one symbol for two words, or if less than half of it is letters.
# A line without closing punctuation fails only if it is too long for a heading.
HEADING_WORDS = 12


def _word_chars(text):
    return F.length(text) - F.regexp_count(text, F.lit(SPACE))


def _symbols(text):
    return F.regexp_count(text, F.lit(SYMBOL))


def _repeated_words(tokens):
    """Words covered by a five-word window that occurs at least twice. Windows are compared by their
    64-bit hash within one document; equal ones stand side by side after one sort, O(n log n)."""
    starts = F.sequence(F.lit(0), F.size(tokens) - WINDOW)
    window = lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    hashes = let(F.transform(tokens, lambda w: F.xxhash64(w)), window)

    def covered(found):
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(pairs):
            same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
            flagged = F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
            return F.array_sort(F.array_compact(flagged))

        step = lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["sum"] + p + WINDOW - F.greatest(a["end"], p)).alias("sum")
        )
        start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("sum"))
        return F.aggregate(let(placed, repeated), start, step)["sum"]

    whole = lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(covered(found))
    return F.when(F.size(tokens) < WINDOW, 0).otherwise(let(hashes, whole))


def _separated(line):
    """Short entries between separators. Counted, not matched as one repeated group: a pattern that recurs once for each
    entry would overflow the stack on a line of many."""
    return (F.regexp_count(line, F.lit(SEPARATOR)) >= 2) & ~F.regexp_like(line, F.lit(UNSEPARATED))


def line_fails(line):
    """Why a line with a word goes: 'navigation', 'boilerplate', 'punctuation', or null if it stays."""
    letters = F.length(F.regexp_replace(line, LETTERS, ""))
    boilerplate = let(F.lower(line), lambda x: reduce(lambda a, b: a | b, [x.contains(p) for p in BOILERPLATE]))
    last = F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1))
    too_many = let(_symbols(line), lambda n: (n > 0) & (n * 2 > F.size(words(line))))
    return (
        F.when(F.regexp_like(F.lower(line), F.lit(NAVIGATION)) | _separated(line), "navigation")
        .when(boilerplate, "boilerplate")
        .when(letters * 2 < _word_chars(line), "punctuation")
        .when(too_many, "punctuation")
        .when((F.instr(F.lit(ENDS), last) == 0) & (F.size(words(line)) > HEADING_WORDS), "punctuation")
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
    clean_text and kept.

    * ``clean_text``: the lines that pass, in their order, with blank lines as they were.
    * ``kept``: false if the base rules fail, or if over half of the word characters stood in failing lines.

    Null or empty text: all counts 0, base_failed, not kept. Repeated rows are judged one by one. Very long texts and
    lines are judged whole; no pattern recurs, so a line may hold any number of separators, spaces or letters. Empty
    table: no rows. Columns of these names in ``docs`` are replaced; other columns, null or not, pass through.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text", "kept"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in made]
    tokens, lines = free_name(docs, "_tokens"), free_name(docs, "_lines")
    body = text_of(f"`{text}`")
    split = docs.select(*rest, words(body).alias(tokens), F.split(body, "\n").alias(lines))
    wordy = F.filter(F.col(lines), has_word)
    failing = F.filter(wordy, lambda x: line_fails(x).isNotNull())
    measured = split.select(
        *rest,
        F.size(tokens).cast("long").alias("n_words"),
        _word_chars(body).cast("long").alias("word_chars"),
        _symbols(body).cast("long").alias("n_symbols"),
        let(wordy, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
        let(F.col(tokens), _repeated_words).cast("long").alias("n_repeat_words"),
        F.aggregate(failing, F.lit(0).cast("long"), lambda a, x: a + _word_chars(x)).alias("lost_chars"),
        F.array_join(F.filter(F.col(lines), lambda x: ~has_word(x) | line_fails(x).isNull()), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)
    )
