"""Each operator over its whole table with production parameters, and its SQL where SQL can say it."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    ann,
    decontaminate,
    lines,
    merkle,
    mixing,
    near,
    packing,
    quality,
    secret_scan,
    sharding,
    suffix,
    toxicity,
    trie,
)
from tidemark.llm.common import table

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


@query()
def op1_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


@query()
def op2_secrets(spark, sf_dir):
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


@query()
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (toxicity.fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "rejected",
    )


LINES_SQL = rf"""
WITH l AS (
  SELECT doc_id, source, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, line
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
b AS (
  SELECT t, min(doc_id) AS first_doc FROM l
  WHERE t <> ''
  GROUP BY t HAVING count(DISTINCT source) >= {lines.MIN_SITES}),
m AS (
  SELECT l.*, b.first_doc IS NOT NULL AND b.first_doc <> l.doc_id AS gone FROM l LEFT JOIN b ON l.t = b.t)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
       count(*) FILTER (t <> '')::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed
FROM m GROUP BY doc_id
"""


@query(LINES_SQL)
def op4_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query()
def op5_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


@query()
def op6_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op7_mixing(spark, sf_dir):
    placed = mixing.schedule(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "source", "bytes", "before", "block", "slot")


@query()
def op8_near_dedup(spark, sf_dir):
    return near.link_groups(table(spark, sf_dir, "documents"), width=2, similarity=80).drop("text_hash", "root")


@query()
def op9_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CHARS = lambda x: f"length(translate({x}, {_SPACE}, ''))"
_Q = lambda s: s.replace("'", "''")
QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i : i + 4] AS gram FROM d, range(1, len(w) - 3) r(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) o(k) GROUP BY doc_id),
l AS (
  SELECT doc_id, line, i, {_CHARS("line")} AS chars, lower(line) AS low
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
    regexp_matches(low, '{_Q(quality.NAVIGATION)}') OR (length(line) - length(regexp_replace(line, '{quality.SEPARATOR}', '', 'g')) >= 2 AND NOT regexp_matches(line, '{quality.UNSEPARATED}'))
    OR {" OR ".join(f"contains(low, '{x}')" for x in quality.BOILERPLATE)}
    OR length(regexp_replace(line, '{_Q(quality.LETTERS)}', '', 'g')) * 2 < chars
    OR 2 * (length(line) - length(regexp_replace(line, '{quality.SYMBOL}', '', 'g'))) > len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))
    OR (NOT contains('{_Q(quality.ENDS)}', right(rtrim(line, {_SPACE}), 1)) AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > {quality.HEADING_WORDS}) AS fails
  FROM l),
s AS (
  SELECT doc_id, count(*) FILTER (chars > 0 AND again) AS n_dup_lines,
         coalesce(sum(chars) FILTER (chars > 0 AND fails), 0) AS lost FROM f GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, {_CHARS("t")}::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '{quality.SYMBOL}', '', 'g')))::BIGINT AS n_symbols,
         s.n_dup_lines::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, lost::BIGINT AS lost_chars
  FROM d JOIN s USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words)
  AND lost_chars * 100 <= word_chars * {quality.MAX_LOST_PERCENT} AS kept
FROM m
"""


@query(QUALITY_SQL)
def op10_quality(spark, sf_dir):
    return quality.measure(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
LEAKS_SQL = f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, least({decontaminate.WINDOW}, len(w)) AS n, w[p : p + least({decontaminate.WINDOW}, len(w)) - 1] AS gram
  FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - {decontaminate.WINDOW}, 0) + 2)) AS p) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (
  SELECT r, p, n, w[p : p + n - 1] AS gram
  FROM d CROSS JOIN (SELECT DISTINCT n FROM g) s, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p)),
m AS (SELECT r, p, n, item FROM x JOIN g USING (n, gram)),
h AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT r, p, n FROM m), LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)
"""


@query(LEAKS_SQL)
def op11_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The parity bit of crc32 of a decimal number, digit by digit.
_CRC32 = """xor(list_reduce(flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(({x})::VARCHAR, '')]),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295), 4294967295)"""
_TOLD = lambda x: f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"
_LEAF = lambda text: f"sha256({_TOLD('doc_id')} || {_TOLD('source')} || {_TOLD('lang')} || {_TOLD('n_chars')} || {_TOLD(text)})"
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF("text")} AS leaf,
    {_LEAF(f"CASE WHEN {_CRC32.format(x='doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS altered
  FROM documents),
n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS total FROM d),
t AS (
  SELECT source, 0 AS level, i, leaf AS h, total FROM n
  UNION ALL
  SELECT source, level + 1, i // {merkle.FAN}, sha256(string_agg(h, '' ORDER BY i)), ceil(max(total) / {merkle.FAN})::BIGINT
  FROM t WHERE total > 1 GROUP BY source, level, i // {merkle.FAN}),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS total FROM t WHERE total = 1),
u AS (
  SELECT 0 AS level, i, subroot AS h, total FROM s
  UNION ALL
  SELECT level + 1, i // {merkle.FAN}, sha256(string_agg(h, '' ORDER BY i)), ceil(max(total) / {merkle.FAN})::BIGINT
  FROM u WHERE total > 1 GROUP BY level, i // {merkle.FAN}),
w AS (
  SELECT n.doc_id, n.source, n.i AS leaf_at, 0 AS part, t.level, n.i // ({merkle.FAN} ** t.level)::BIGINT AS pos, t.i, t.h
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source AND t.total > 1
    AND n.i // ({merkle.FAN} ** (t.level + 1))::BIGINT = t.i // {merkle.FAN}
  UNION ALL
  SELECT n.doc_id, n.source, n.i, 1, u.level, s.i // ({merkle.FAN} ** u.level)::BIGINT, u.i, u.h
  FROM n JOIN s ON n.source IS NOT DISTINCT FROM s.source JOIN u ON u.total > 1
    AND s.i // ({merkle.FAN} ** (u.level + 1))::BIGINT = u.i // {merkle.FAN}),
g AS (
  SELECT doc_id, source, leaf_at, part, level, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < pos), '') AS l,
         coalesce(string_agg(h, '' ORDER BY i) FILTER (i > pos), '') AS r
  FROM w GROUP BY doc_id, source, leaf_at, part, level),
p AS (
  SELECT doc_id, source, leaf_at, string_agg(l || r, '' ORDER BY part, level) AS told,
         list([l, r] ORDER BY part, level) AS path FROM g GROUP BY doc_id, source, leaf_at),
f AS (
  SELECT n.doc_id, n.leaf, s.subroot, (SELECT h FROM u WHERE total = 1) AS root, sha256(coalesce(told, '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda a, x: [sha256(x[1] || a[1] || x[2])], [altered])[1] AS folded_root
  FROM n JOIN s ON n.source IS NOT DISTINCT FROM s.source
    LEFT JOIN p ON n.source IS NOT DISTINCT FROM p.source AND n.i = p.leaf_at)
SELECT *, folded_root = root AS verified FROM f
"""


@query(MERKLE_SQL)
def op12_merkle(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, h, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n, k, strlen(text) AS bytes
  FROM (SELECT conv_id, turn, text, md5(strlen(role) || ':' || role || ':' || text) AS k,
               {_CRC32.format(x="conv_id")} % {trie.LONGEST_HEAD + 1} AS h, conv_id - conv_id % {trie.GROUP} AS b
        FROM (SELECT * REPLACE (coalesce(role, '') AS role, coalesce(text, '') AS text) FROM conversations WHERE conv_id IS NOT NULL))),
c AS (SELECT DISTINCT conv_id, h, b, n FROM t),
a AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS taken FROM c LEFT JOIN c o ON o.conv_id = c.b),
r AS (
  SELECT a.conv_id, t.pos AS d, t.k, t.bytes FROM a JOIN t ON t.conv_id = a.b AND t.pos <= a.h
  UNION ALL
  SELECT a.conv_id, t.pos - a.h + a.taken, t.k, t.bytes FROM a JOIN t ON t.conv_id = a.conv_id AND t.pos > a.h),
p AS (
  SELECT conv_id, d, bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS name,
         d = count(*) OVER (PARTITION BY conv_id) AS ends FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '', NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = a.conv_id) FROM a),
n AS (
  SELECT name, min(conv_id) AS conv_id, d AS depth, count(*) AS n_convs, max(bytes) AS bytes, left(name, greatest(d - 1, 0) * 32) AS parent,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM p GROUP BY name, d),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.name),
s AS (
  SELECT left(name, up * 32) AS name, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM f, LATERAL (SELECT unnest(range(0, depth + 1)) AS up) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (name) LEFT JOIN n q ON f.depth > 0 AND q.name = f.parent
"""


@query(TRIE_SQL)
def op13_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
