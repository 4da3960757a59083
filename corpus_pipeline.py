"""The training-data pipeline over ``documents``: each stage is written and reread by the next."""

from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, near, packing, toxicity
from tidemark.llm.common import free_name, table, text_of
from tidemark.plans.workspace import settle


def drop_toxic(spark, docs, sf_dir):
    """Documents whose score reaches the threshold of their language go. The classifier learns from the
    labelled documents of this table."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def drop_boilerplate(spark, docs, sf_dir):
    """Lines that stand on many sources go from all but one document, however few words they have. A document of which nothing is left
    goes (its whole text stays in others); one that was empty before stays. n_chars follows the text."""
    cleaned = lines.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    n_chars = F.when(F.col("n_removed") > 0, F.length(text_of())).otherwise(F.col("n_chars"))
    return cleaned.filter(~emptied).withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def drop_copies(spark, docs, sf_dir):
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one document stays: the smallest id, then
    the smallest text hash, so that one stays also where ids are missing or repeated. Rows that repeat an id and its text
    count once. Documents without a word stay."""
    groups = near.link_groups(docs, width=5, similarity=80)
    at, text_hash = free_name(docs, "_at"), free_name(docs, "_text_hash")
    # No id is the least long, so that null ids meet as well; among the members of a group it comes last.
    never = F.lit(-(1 << 63))
    key = F.coalesce("doc_id", never).alias(at), F.col("text_hash").alias(text_hash)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = groups.filter("root IS NOT NULL").groupBy("root").agg(F.min_by(F.struct(*key), order).alias("first"))
    wordless = groups.filter("root IS NULL").select(*key)
    stay = first.select("first.*").unionByName(wordless).distinct()
    keyed = docs.withColumns({at: F.coalesce(F.col("doc_id").cast("long"), never), text_hash: F.xxhash64(text_of())})
    return keyed.join(stay, [at, text_hash], "left_semi").dropDuplicates([at, text_hash]).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """All documents, laid out in the order in which their sources take turns."""
    return mixing.mixed(docs)


def pack_tokens(spark, docs, sf_dir):
    """Pieces of token sequences, as ``packing.pack`` gives them."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

# Training, signatures, schedules and token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
