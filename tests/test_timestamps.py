import pytest
from pyspark.sql import functions as F

from tidemark.functions import timestamps as ts

SHOWN = "Aug 11, 2025 @ 14:20:05.648"
ISO = "2025-08-11T14:20:05.648Z"
EPOCH = "1970-01-01T00:00:00Z"


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def session_zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def one(spark, value, build):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, zone, expected",
    [
        (SHOWN, "UTC", ISO),
        (SHOWN, "America/New_York", "2025-08-11T18:20:05.648Z"),
        (ISO, "UTC", ISO),
        (ISO, "America/New_York", ISO),
        ("2025-08-11T14:20:05Z", "UTC", "2025-08-11T14:20:05Z"),
        ("2025-08-11T14:20:05.123456Z", "UTC", "2025-08-11T14:20:05.123456Z"),
        (None, "UTC", EPOCH),
        ("", "UTC", EPOCH),
        ("garbage", "UTC", EPOCH),
        ("2025", "UTC", EPOCH),
        ("2025-08-11", "UTC", EPOCH),
        ("2025-13-41T99:00:00Z", "UTC", EPOCH),
    ],
)
def test_to_instant(spark, session_zone, text, zone, expected):
    assert one(spark, text, lambda c: ts.iso_text(ts.to_instant(c, zone))) == expected


@pytest.mark.parametrize(
    "text, zone, expected",
    [
        (ISO, "UTC", SHOWN),
        (ISO, "America/New_York", "Aug 11, 2025 @ 10:20:05.648"),
        (SHOWN, "UTC", SHOWN),
        ("2024-02-03T04:05:06.789999Z", "UTC", "Feb 3, 2024 @ 04:05:06.789"),
        (None, "UTC", "Jan 1, 1970 @ 00:00:00.000"),
        ("", "UTC", "Jan 1, 1970 @ 00:00:00.000"),
        ("garbage", "UTC", "Jan 1, 1970 @ 00:00:00.000"),
    ],
)
def test_to_display(spark, session_zone, text, zone, expected):
    assert one(spark, text, lambda c: ts.to_display(c, zone)) == expected


def test_time_order_is_not_text_order(spark):
    later = lambda c: ts.to_instant(c) > ts.to_instant(F.lit("2024-01-01T00:00:00Z"))
    assert one(spark, "2024-01-01T00:00:00.123Z", later)
    assert "2024-01-01T00:00:00.123Z" < "2024-01-01T00:00:00Z"


def test_bounds_mean_utc_in_every_session(spark, session_zone):
    from datetime import datetime, timedelta, timezone

    want = 1_704_067_200_000_000
    forms = [
        want,
        datetime(2024, 1, 1),
        datetime(2024, 1, 1, 5, 30, tzinfo=timezone(timedelta(hours=5, minutes=30))),
        "2024-01-01 00:00:00",
        "2024-01-01T00:00:00Z",
    ]
    for form in forms:
        assert spark.range(1).select(F.unix_micros(ts.as_bound(form))).first()[0] == want
    assert spark.range(1).select(ts.as_bound(None).alias("r")).first().r is None


def test_effective_and_safe_start(spark):
    rows = spark.sql("SELECT timestamp'2024-01-02' AS last, begun FROM VALUES (null), (timestamp'2024-01-01'), (timestamp'2024-01-03') AS t(begun)")
    got = rows.select(
        ts.effective_start(F.col("begun"), F.col("last")).cast("date").cast("string").alias("plain"),
        ts.safe_start(F.col("begun"), F.col("last")).cast("date").cast("string").alias("safe"),
    ).collect()
    assert {(r.plain, r.safe) for r in got} == {
        ("2024-01-02", "2024-01-02"),
        ("2024-01-01", "2024-01-01"),
        ("2024-01-03", "2024-01-02"),
    }
