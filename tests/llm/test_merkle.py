import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.queries import op12_merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([_h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return out


def _expected(rows):
    """The manifest by the plain definition. rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        other = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            other = text.replace("\n", "")
        leaf, altered = (_h(*map(_told, (doc_id, source, lang, n, t))) for t in (text, other))
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), leaf, altered))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([leaf for _, leaf, _ in sorted(groups[s])]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    out = []
    for place, source in enumerate(order):
        for i, (key, leaf, altered) in enumerate(sorted(groups[source])):
            told, node = "", altered
            for levels, at in ((trees[source], i), (top, place)):
                for level in levels[:-1]:
                    first = at // 3 * 3
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 3])
                    told, node, at = told + left + right, _h(left, node, right), at // 3
            out.append((key[1] if key[0] else None, leaf, trees[source][-1][0], top[-1][0], _h(told), node, node == top[-1][0]))
    return sorted(map(repr, out))


def _got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("levels", [1, 5])
def test_proofs_equal_the_definition_over_one_to_many_rounds(docs_of, levels):
    dice = random.Random(levels)
    sizes = {None: 2, "": 1, "a": 1, "b": 3, "é": 4, "hot": 260, "z": 28}
    ids = iter(dice.sample(range(10_000), sum(sizes.values())))
    rows = [(next(ids), dice.choice(["x\ny", "é\n", "", None, "plain"]), s) for s, n in sizes.items() for _ in range(n)]
    docs = docs_of(rows)
    assert _got(merkle.audit(docs, levels=levels)) == _expected([tuple(r) for r in docs.collect()])


def test_only_deleted_newlines_break_a_proof(docs_of):
    docs = docs_of([(i, "line\nline" if i % 3 else "line", f"s{i % 4}") for i in range(200)])
    for r in merkle.audit(docs).collect():
        broken = r.doc_id % 3 and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        assert r.verified == (not broken)


def test_nulls_repeats_ties_long_texts_clashing_names_and_no_rows(spark, docs_of):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None), (2, "d\n" * 500_000), (3, ""), (4, None, None)]
    docs = docs_of(rows).withColumns({"root": F.lit(1), "hash": F.lit("x"), "pos": F.lit(2), "_key0": F.lit(3), "member": F.lit(4)})
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert _got(merkle.audit(docs)) == _expected([tuple(r) for r in plain.collect()])
    assert merkle.audit(docs.limit(0)).count() == 0
    kept = merkle.proofs(docs, keep=("doc_id", "root"))
    assert kept.columns[:3] == ["doc_id", "_root", "leaf"] and {r._root for r in kept.collect()} == {1}


def test_a_single_record_is_its_own_root(docs_of):
    row = merkle.audit(docs_of([(7, "only")])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == _h("")


def test_the_manifest_lists_each_group_once(docs_of):
    docs = docs_of([(i, f"t{i}", ["a", "b", None][i % 3]) for i in range(30)])
    rows = {r.source: r for r in merkle.manifest(docs).collect()}
    assert {s: r.n for s, r in rows.items()} == {"a": 10, "b": 10, None: 10} and len({r.root for r in rows.values()}) == 1
    order = "".join(rows[s].subroot for s in (None, "a", "b"))
    assert rows["a"].root == _h(order)


def test_the_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert _got(op12_merkle(spark, sf)) == _expected([tuple(r) for r in docs.collect()])
