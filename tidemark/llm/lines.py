"""Line deduplication by spread over sites, with built-in functions only.

A line that stands on many distinct sites is boilerplate. One HyperLogLog sketch of the sites per line
hash merges by aggregation, so a line that half the corpus carries is one small buffer per task. Where the
estimate is too near the threshold to decide, the distinct sites are counted exactly.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, free_name, text_of, words
from tidemark.plans.workspace import settle

MIN_SITES = 10
LG_K = 12
# Relative error at 2**12 registers is under 2 %; outside this band the estimate decides.
BAND = 0.15


def _trimmed(line):
    return F.btrim(line, F.lit(SPACES))


def _exploded(docs, doc_id, text, site, min_words):
    body = text_of(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(body).alias("text_hash"),
        F.col(f"`{site}`").alias("site"),
        F.explode(F.split(body, "\n")).alias("line"),
    ).withColumn("line", _trimmed(F.col("line")))
    # Two independent hashes, 96 bits: no two lines of a corpus should share both.
    return rows.filter(F.size(words(F.col("line"))) >= min_words).select(
        "doc_id", "text_hash", "site", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first_doc) of the lines on at least ``min_sites`` sites. A null site is no site."""
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    spread = lines.groupBy("h1", "h2").agg(sketch.alias("sites"), F.min("doc_id").alias("first_doc"))
    spread = settle(spread.filter(F.col("sites") >= low), "spread")
    near = spread.filter(F.col("sites") < high)
    counted = (
        lines.select("h1", "h2", "site").filter("site IS NOT NULL").distinct()
        .join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2").count().filter(F.col("count") >= min_sites)
    )
    exact = near.join(counted.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return spread.filter(F.col("sites") >= high).unionByName(exact).select("h1", "h2", "first_doc")


def dedup_lines(
    docs: DataFrame, doc_id="doc_id", text="text", site="source", min_sites: int = MIN_SITES, min_words: int = 1
) -> DataFrame:
    """``docs`` without boilerplate lines, plus n_lines and n_removed (lines with a word).

    Boilerplate: lines with a word (or with ``min_words`` of them), compared without surrounding white space, on at least
    ``min_sites`` distinct sites. The document with the smallest id that carries such a line keeps it, so
    no text leaves the corpus; every other document loses it. Other lines stay byte for byte.

    Null text: stays null, counts 0. Null site: counts as no site, its lines are still removed. Null id:
    never the keeper; a line that only rows without an id carry stays. Repeated rows (same id and text) are
    treated alike. Columns named n_lines or n_removed are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    lines = _exploded(docs, doc_id, text, site, min_words)
    boilerplate = settle(spread_lines(lines, min_sites), "boilerplate")
    hits = (
        lines.select("doc_id", "text_hash", "h1", "h2")
        .join(boilerplate, ["h1", "h2"])
        .filter(F.col("first_doc").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_text"))
        .agg(F.collect_set("h1").alias("_hit"))
    )
    id_name, hash_name, hit, parts = (free_name(docs, n) for n in ("_hit_id", "_hit_text", "_hit", "_parts"))
    hits = hits.toDF(id_name, hash_name, hit)
    body = text_of(f"`{text}`")
    joined = docs.join(
        hits, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_name)) & (F.xxhash64(body) == F.col(hash_name)), "left"
    )
    stays = lambda x: ~F.coalesce(F.array_contains(F.col(hit), F.xxhash64(_trimmed(x))), F.lit(False))
    wordy = lambda a: F.size(F.filter(a, lambda x: _trimmed(x) != "")).cast("long")
    split = F.split(body, "\n")
    left = F.when(F.col(hit).isNull(), split).otherwise(F.filter(split, stays))
    out = joined.withColumn(parts, left)
    return out.select(
        *[
            F.when(F.col(hit).isNull(), F.col(f"`{c}`")).otherwise(F.array_join(parts, "\n")).alias(c)
            if c == text
            else F.col(f"`{c}`")
            for c in kept
        ],
        wordy(split).alias("n_lines"),
        (wordy(split) - wordy(F.col(parts))).alias("n_removed"),
    )
