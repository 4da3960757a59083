"""Secret scan through a trigram index.

Each rule's pattern gives a Boolean trigram query. The queries are evaluated on the index's postings, shard
by shard; only documents that satisfy a rule's query are searched for that rule. Rules without a mandatory
trigram are searched in every document.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, text_of
from tidemark.llm.trigrams import ANY, DOCS, build_index, trigram_query, trigrams_in, unpack_postings
from tidemark.plans.workspace import fresh_path, settle


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; those whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Three base rules, then public formats of well-known credentials.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _satisfying(query, postings, n):
    if isinstance(query, int):
        return postings.get(query, np.zeros(n, dtype=bool))
    parts = [_satisfying(q, postings, n) for q in query[1:]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, mask): bit r is set if the document satisfies the query of rule r. Only postings of the
    rules' own trigrams are read; a shard's postings meet in one task, and a shard is bounded."""
    queries = {r: q for r, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) != ANY}
    wanted = sorted(set().union(*map(trigrams_in, queries.values())))

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        listed = shard[shard["trigram"] == DOCS]
        n = int(listed["n_docs"].iloc[0])
        doc_ids = np.frombuffer(listed["doc_ids"].iloc[0], dtype="<i8")
        rest = shard[shard["trigram"] != DOCS]
        postings = {int(t): unpack_postings(p, n) for t, p in zip(rest["trigram"], rest["postings"], strict=True)}
        mask = np.zeros(n, dtype=np.int64)
        for r, query in queries.items():
            mask |= _satisfying(query, postings, n).astype(np.int64) << r
        found = mask != 0
        return pd.DataFrame({"doc_id": doc_ids[found], "mask": mask[found]})

    read = index.filter(F.col("trigram").isin([*wanted, DOCS]))
    found = read.groupBy("shard").applyInPandas(search, "doc_id long, mask long")
    return found.groupBy("doc_id").agg(F.bit_or("mask").alias("mask"))


def find_spans(text: str, rules, mask: int):
    spans = []
    for r, (kind, pattern, group, least) in enumerate(rules):
        if mask >> r & 1:
            spans.extend(
                (m.start(), r, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least
            )
    return [{"kind": rules[r][0], "start": start, "end": end} for start, r, end in sorted(spans)]


def scan(docs: DataFrame, rules=RULES, doc_id="doc_id", text="text", index_path: str | None = None) -> DataFrame:
    """``docs`` with ``spans``: kind, start and end (code points, end exclusive) of each secret, by start,
    then by rule order.

    Null or empty text: no spans. Null id: not in the index, so every rule is searched in full. Repeated
    ids: a document is searched for a rule if any row of its id is a candidate; spans are each row's own.
    Spans of different kinds may overlap. A column named spans is replaced; other columns pass through.
    """
    kept = [c for c in docs.columns if c.lower() != "spans"]
    index = build_index(docs, index_path or fresh_path(docs.sparkSession, "trigrams"), doc_id, text)
    found_id, mask = free_name(docs, "_found_id"), free_name(docs, "_mask")
    found = settle(candidates(index, rules), "candidates").toDF(found_id, mask)
    always = sum(1 << r for r, rule in enumerate(rules) if trigram_query(rule.pattern) == ANY)
    every = (1 << len(rules)) - 1
    compiled = [(rule.kind, re.compile(rule.pattern, re.ASCII), rule.group, rule.least) for rule in rules]

    # Arrow arrays, so that one text at a time becomes a Python string.
    @F.arrow_udf(SPAN)
    def verified(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, masks in parts:
            found = [find_spans(t.as_py(), compiled, m) for t, m in zip(texts, masks.to_pylist(), strict=True)]
            yield pa.array(found, type=_SPANS)

    bits = F.when(F.col(f"`{doc_id}`").isNull(), every).otherwise(F.coalesce(F.col(mask), F.lit(0)).bitwiseOR(F.lit(always)))
    joined = docs.join(found, F.col(f"`{doc_id}`").cast("long") == F.col(found_id), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], verified(text_of(f"`{text}`"), bits.cast("long")).alias("spans"))


def as_text(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(scanned: DataFrame, doc_id="doc_id") -> DataFrame:
    """Counts and digests of the spans of each row."""
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        *[of_kind(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
