from tests.util import ids
from tidemark import jobs
from tidemark.sources.store import OffsetStore


def test_load_consume_stream_status(spark, folder, capsys):
    raw, table, store = folder + "/raw", folder + "/events", folder + "/store"
    rows = [("completion_1", "view", "u1", "2024-01-01T00:00:00Z"), ("other", "view", "u2", "2024-01-02T00:00:00Z")]
    frame = spark.createDataFrame(rows, "doc_id string, event_type string, user_id string, timestamp string")
    frame.write.json(raw)
    for _ in range(2):  # the second load meets the table and updates it
        jobs.main(["load", "--raw", raw, "--events", table], spark)
    common = ["--events", table, "--store", store]
    jobs.main(["consume", *common, "--consumer", "one", "--sink", folder + "/one"], spark)
    jobs.main(["consume", *common, "--prefix", "completion_", "--batch-size", "0"], spark)
    jobs.main(["stream", *common, "--consumer", "two", "--sink", folder + "/two"], spark)
    assert sorted(ids(spark.read.parquet(folder + "/one"))) == ["completion_1", "other"]
    assert sorted(ids(spark.read.parquet(folder + "/two"))) == ["completion_1", "other"]
    totals = {r.consumer_id: r.total_processed for r in OffsetStore(spark, store).latest().collect()}
    assert totals == {"one": 2, "readonly-consumer-events": 1, "two": 2}
    jobs.main(["consume", *common, "--consumer", "one", "--seek", "2024-01-01T12:00:00Z"], spark)
    assert OffsetStore(spark, store).load("one", "events").total == 3
    capsys.readouterr()
    jobs.main(["status", "--store", store], spark)
    assert "readonly-consumer-events" in capsys.readouterr().out
