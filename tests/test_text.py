from pyspark.sql import functions as F

from tidemark.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first().r


def test_key_text(spark):
    assert one(spark, text.offset_key(F.lit("prod-consumer-1"), F.lit("events"))) == "prod-consumer-1_events"


def test_lines(spark):
    line = text.event_line(F.lit("e1"), F.lit("view"), F.lit("u1"), F.lit("x"))
    assert one(spark, line) == "Processing event: e1 - Type: view - User: u1 - Data: x"
    body = text.payload(F.lit("view"), F.lit("u1"), F.lit("2024-01-01T00:00:00Z"))
    assert one(spark, body) == "Sample data for view event by u1 at 2024-01-01T00:00:00Z"


def test_content_id_separates_fields(spark):
    ab = [one(spark, text.content_id(F.lit(a), F.lit(b))) for a, b in [("ab", "c"), ("a", "bc"), ("a", None), ("a", "")]]
    assert len(set(ab)) == 4
    assert one(spark, text.content_id(F.lit("ab"), F.lit("c"))) == ab[0]


def test_random_ids(spark):
    made = [r[0] for r in spark.range(20).select(text.random_consumer_id()).collect()]
    assert len(set(made)) == 20
    assert all(m.startswith("consumer-") and len(m) == 17 for m in made)
    assert len(one(spark, text.random_id())) == 36


def test_outcome(spark):
    got = spark.createDataFrame([("x",), (None,)], "e string").select(text.write_outcome(F.col("e"))).collect()
    assert [r[0] for r in got] == ["updated", "created"]
