import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.util import T0, events, ids
from tidemark.operators.upsert import ingest, upsert_outcome
from tidemark.schemas import EVENTS
from tidemark.sources import tables
from tidemark.sources.events import decode_documents, decode_or_set_aside, scan_events, scan_if_present
from tidemark.sources.sequence import Sequence, numbered
from tidemark.sources.files import child_names
from tidemark.sources.tables import create_if_absent, load_events, upsert_into, write_by_day

DAY = 86_400


def state(spark, path):
    return {(r.doc_id, r.event_type, r.d) for r in spark.read.parquet(path).select("doc_id", "event_type", F.dayofmonth("timestamp").alias("d")).collect()}


def test_created_only_if_absent(spark, folder):
    path = folder + "/events"
    assert create_if_absent(spark, path) is True
    assert create_if_absent(spark, path) is False
    assert scan_events(spark, path).count() == 0
    other = T.StructType([T.StructField("x", T.LongType())])
    with pytest.raises(ValueError):
        create_if_absent(spark, path, other)


def test_absent_table_is_empty_and_unreadable_table_raises(spark, folder):
    assert scan_if_present(spark, folder + "/none").schema == EVENTS
    assert scan_if_present(spark, folder + "/none").count() == 0
    spark.range(3).write.json(folder + "/text")
    with pytest.raises(Exception):
        scan_if_present(spark, folder + "/text").count()
    with pytest.raises(AnalysisException):
        scan_events(spark, folder + "/none").count()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_formats(spark, folder, fmt):
    events(spark, [("a", 1), ("b", 2)]).write.format(fmt).save(folder + "/t")
    assert sorted(ids(scan_events(spark, folder + "/t", fmt=fmt))) == ["a", "b"]


def test_upsert_rewrites_touched_days_and_moves_events(spark, folder):
    path = folder + "/events"
    write_by_day(events(spark, [("a", 0), ("b", 1), ("c", DAY), ("d", 5 * DAY)]), path)
    untouched = [f.getPath().getName() for f in _list(spark, path + "/event_date=2024-01-06")]
    # b changes, c moves to the first day and leaves its own empty, e is new
    incoming = events(spark, [("b", 1, "new"), ("c", 3, "new"), ("e", 2 * DAY, "new")])
    outcome = {r.outcome: r.n for r in upsert_outcome(spark.read.parquet(path), incoming).collect()}
    assert outcome == {"created": 1, "updated": 2}
    want = {("a", "view", 1), ("b", "new", 1), ("c", "new", 1), ("d", "view", 6), ("e", "new", 3)}
    for _ in range(2):  # a rerun changes nothing
        upsert_into(spark, path, incoming)
        assert state(spark, path) == want
    assert [f.getPath().getName() for f in _list(spark, path + "/event_date=2024-01-06")] == untouched


def test_upsert_takes_the_newest_version(spark, folder):
    path = folder + "/events"
    write_by_day(events(spark, [("a", 0)]), path)
    twice = events(spark, [("a", 0, "old")]).withColumn("v", F.lit(1)).union(events(spark, [("a", 0, "newest")]).withColumn("v", F.lit(2)))
    upsert_into(spark, path, twice, version="v")
    assert state(spark, path) == {("a", "newest", 1)}


def _list(spark, path):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return list(handle.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(handle))


def test_decode(spark):
    good = '{"doc_id": "a", "timestamp": "2024-01-01T00:00:00Z", "event_type": "view", "user_id": "u", "data": "d"}'
    docs = spark.createDataFrame([("1", good), ("2", None), ("3", '{"doc_id": "b'), ("4", "{}"), ("5", "junk")], "_id string, body string")
    row = decode_documents(docs).select("_id", "doc_id", F.unix_micros("timestamp").alias("us"), "event_type").collect()
    assert [tuple(r) for r in row] == [("1", "a", T0, "view")]


def test_ingest_fills_in_and_repeats(spark):
    raw = spark.createDataFrame([("view", "u1"), ("view", "u2")], "event_type string, user_id string")
    at = F.timestamp_micros(F.lit(T0))
    once, again = ingest(raw, at).collect(), ingest(raw, at).collect()
    assert once == again and len({r.doc_id for r in once}) == 2
    assert once[0].data == "Sample data for view event by u1 at 2024-01-01T00:00:00Z"
    given = raw.select("*", F.lit("mine").alias("doc_id"), F.lit("body").alias("data"))
    assert {(r.doc_id, r.data) for r in ingest(given, at).collect()} == {("mine", "body")}
    stamped = ingest(raw).select((F.abs(F.unix_seconds(F.current_timestamp()) - F.unix_seconds("timestamp")) < 60).alias("near"))
    assert all(r.near for r in stamped.collect())


def _table(spark, path):
    return sorted((r.doc_id, r.event_type) for r in spark.read.parquet(path).collect())


def test_an_upsert_opens_only_the_days_it_hits(spark, folder):
    day = 86_400
    path = folder + "/t"
    load_events(spark, path, events(spark, [(f"e{d}_{i}", d * day + i) for d in range(8) for i in range(5)]))
    moved = events(spark, [("e2_1", 5 * day, "moved"), ("new", 5 * day + 1, "new"), ("e2_3", 2 * day + 9, "again")])
    assert sorted(str(d) for d in upsert_into(spark, path, moved)) == ["2024-01-03", "2024-01-06"]
    # once more: by the index e2_1 may still be in its old day
    assert sorted(str(d) for d in upsert_into(spark, path, moved.filter("doc_id = 'e2_1'"))) == ["2024-01-03", "2024-01-06"]
    got = dict(_table(spark, path))
    assert len(_table(spark, path)) == len(got) == 41 and (got["e2_1"], got["new"], got["e2_3"]) == ("moved", "new", "again")


def test_an_upsert_that_ends_in_between_is_finished_by_the_next_reader(spark, folder, monkeypatch):
    path, day = folder + "/t", 86_400
    load_events(spark, path, events(spark, [("a", 0), ("b", day), ("c", 2 * day)]))

    def one_move_only(spark, told):
        tables.move_once(spark, *told["moves"][0])
        raise RuntimeError("ended")

    with monkeypatch.context() as m:
        m.setattr(tables, "_apply", one_move_only)
        with pytest.raises(RuntimeError, match="ended"):
            upsert_into(spark, path, events(spark, [("a", day, "moved"), ("c", 0, "moved")]))
    read = scan_if_present(spark, path)
    assert sorted((r.doc_id, r.event_type) for r in read.collect()) == [("a", "moved"), ("b", "view"), ("c", "moved")]
    assert not [n for n in child_names(spark, path) if n.startswith("_staged")]


def test_an_upsert_that_another_overtook_starts_again(spark, folder, monkeypatch):
    path = folder + "/t"
    load_events(spark, path, events(spark, [("a", 0)]))
    real, meddled = tables.create_with, []

    def meddling(spark, target, text):
        if not meddled:
            meddled.append(True)
            upsert_into(spark, path, events(spark, [("b", 1)]))
        return real(spark, target, text)

    monkeypatch.setattr(tables, "create_with", meddling)
    upsert_into(spark, path, events(spark, [("c", 2), ("a", 3, "new")]))
    assert _table(spark, path) == [("a", "new"), ("b", "view"), ("c", "view")]


def test_loads_keep_one_row_an_id(spark, folder):
    """Also within one load, in the first one, and with equal times; a table written without an index gets one."""
    path = folder + "/t"
    rows = [("e1", 0, "x"), ("e1", 5, "y"), ("e1", 5, "z"), ("e2", 1, "x"), ("e2", 1, "x")]
    for _ in range(2):
        load_events(spark, path, events(spark, rows))
        assert _table(spark, path) == [("e1", "z"), ("e2", "x")]
    other = folder + "/plain"
    write_by_day(events(spark, [("a", 0), ("b", 86_400)]), other)
    upsert_into(spark, other, events(spark, [("b", 0, "moved")]))
    assert _table(spark, other) == [("a", "view"), ("b", "moved")]


def test_every_document_is_decoded_or_set_aside_with_a_reason(spark):
    bodies = {
        1: '{"doc_id": "a", "timestamp": "2024-01-01T00:00:00Z", "colour": "red", "deep": {"x": [1, 2]}}',
        2: None, 3: "", 4: "{oops", 5: "[1, 2]", 6: '"text"', 7: "{}", 8: '{"doc_id": null, "data": "d"}',
        9: '{"doc_id": "b", "timestamp": "yesterday"}', 10: '{"doc_id": 7, "data": null}', 11: "null",
    }
    docs = spark.createDataFrame(list(bodies.items()), "offset int, body string")
    accepted, aside = decode_or_set_aside(docs)
    got = {r.offset: r for r in accepted.collect()}
    assert sorted(got) == [1, 10] and got[10].doc_id == "7" and got[10].data is None and got[10].unknown == {}
    assert got[1].unknown == {"colour": "red", "deep": '{"x":[1,2]}'} and got[1].timestamp is not None
    why = {r.offset: r.reason for r in aside.collect()}
    assert why == {
        2: "missing body", 3: "malformed body", 4: "malformed body", 5: "body is no object", 6: "body is no object",
        7: "no value of a required field", 8: "no value of a required field", 9: "field not of its type: timestamp",
        11: "body is no object",
    }
    assert len(got) + len(why) == len(bodies)
    assert decode_or_set_aside(docs.limit(0))[0].count() == 0


def test_a_document_is_parsed_once_for_its_reason(spark):
    rows = [(1, ' {"doc_id": "a"}'), (2, "\n[1]"), (3, '{"doc_id": "b", "timestamp": {}}'), (4, '{"doc_id": [1], "data": {"x": 1}}')]
    docs = spark.createDataFrame(rows, "offset int, body string")
    accepted, aside = decode_or_set_aside(docs)
    for part in (accepted, aside):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert {r.offset: (r.doc_id, r.data) for r in accepted.collect()} == {1: ("a", None), 4: ("[1]", '{"x":1}')}
    assert {r.offset: r.reason for r in aside.collect()} == {2: "body is no object", 3: "field not of its type: timestamp"}
    texts = T.StructType([T.StructField("doc_id", T.StringType())])
    assert [x.count() for x in decode_or_set_aside(docs, texts)] == [3, 1]


def test_loads_number_their_rows_without_gaps(spark, folder):
    def load(token, rows):
        df = numbered(events(spark, rows), Sequence(spark, folder + "/seq"), token)
        return [(r.seq, r.doc_id) for r in df.select("seq", "doc_id").orderBy("seq").collect()]

    assert load("one", [("b", 2), ("a", 1), ("c", 2)]) == [(0, "a"), (1, "b"), (2, "c")]
    assert load("none", []) == []
    assert load("two", [("d", 0)]) == [(3, "d")]
    # a load that is repeated keeps its numbers
    assert load("one", [("c", 2), ("a", 1), ("b", 2)]) == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(ValueError, match="claimed 3"):
        load("one", [("a", 1)])
    assert Sequence(spark, folder + "/seq").next() == 4


def test_claims_at_once_are_distinct_and_gapless(spark, folder):
    import threading

    got = []
    work = lambda n: got.append((Sequence(spark, folder).claim(n, f"load-{n}"), n))
    threads = [threading.Thread(target=work, args=(n,)) for n in range(1, 13)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    taken = sorted(x for first, n in got for x in range(first, first + n))
    assert len(got) == 12 and taken == list(range(sum(range(1, 13))))
