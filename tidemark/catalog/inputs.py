"""Inputs of the catalog queries. All derive from the whole ``events`` table.

``*_SQL`` are the same definitions for the SQL side.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timestamps import as_bound

RAW = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
NTZ = T.TimestampNTZType()
ORDER = ("ts", "event_id")
OWNER = ("consumer_id", "index_name")

# Parameters shared by both sides.
BOUND = "2024-01-10 00:00:00"
RESENT_FROM = "2024-01-05 00:00:00"
COMMITS_UNTIL = "2024-01-25 00:00:00"
AS_OF = "2024-02-01 00:00:00"
PREFIX = "purchase_"
K = 50
AFTER_SEQ = 500
SESSION_START = 500


def at(text):
    return as_bound(text, NTZ)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(RAW).parquet(f"{sf_dir}/events.parquet")


def with_keys(raw: DataFrame) -> DataFrame:
    """The event with its document id, the consumer that owns it and the index it is in."""
    return raw.select(
        "*",
        F.concat_ws("_", "event_type", "event_id").alias("doc_id"),
        F.concat(F.lit("c"), F.col("user_id") % 4).alias("consumer_id"),
        F.col("event_type").alias("index_name"),
    )


def ev(spark, sf_dir):
    return with_keys(raw_events(spark, sf_dir))


def by_minute(events):
    """Times cut to the minute, so that many are equal."""
    return events.withColumn("ts", F.date_trunc("minute", "ts").cast(NTZ))


EV_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         event_type || '_' || event_id AS doc_id,
         'c' || (user_id % 4) AS consumer_id, event_type AS index_name
  FROM events
),
mins AS (SELECT * REPLACE (date_trunc('minute', ts)::TIMESTAMP AS ts) FROM ev)"""


def offsets(events):
    """Where each consumer stands: its newest event before a date that differs by index.

    c3 has never committed. c1 was interrupted in a read begun a day before its last event, c2 in
    one begun an hour after it.
    """
    cut = (
        F.when(F.col("index_name") == "purchase", at("2024-01-05 00:00:00"))
        .when(F.col("index_name") == "click", at("2024-01-20 00:00:00"))
        .otherwise(at("2024-01-10 00:00:00"))
    )
    past = (F.col("consumer_id") != "c3") & (F.col("ts") < cut)
    done = F.when(past, F.col("ts"))
    grouped = events.groupBy(*OWNER).agg(
        F.max(done).alias("last_ts"), F.max_by("event_id", done).alias("last_id"), F.count_if(past).alias("total")
    )
    last = F.col("last_ts")
    return grouped.select(
        *OWNER,
        "last_ts",
        "last_id",
        "total",
        F.when(F.col("consumer_id") == "c1", last - F.expr("INTERVAL 1 DAY"))
        .when(F.col("consumer_id") == "c2", last + F.expr("INTERVAL 1 HOUR"))
        .alias("query_start"),
    )


OFF_SQL = """
past AS (
  SELECT *, consumer_id <> 'c3' AND ts < CASE index_name
           WHEN 'purchase' THEN TIMESTAMP '2024-01-05 00:00:00'
           WHEN 'click' THEN TIMESTAMP '2024-01-20 00:00:00'
           ELSE TIMESTAMP '2024-01-10 00:00:00' END AS done
  FROM ev
),
off0 AS (
  SELECT consumer_id, index_name,
         max(ts) FILTER (WHERE done) AS last_ts,
         arg_max(event_id, ts) FILTER (WHERE done) AS last_id,
         count(*) FILTER (WHERE done) AS total
  FROM past GROUP BY consumer_id, index_name
),
off AS (
  SELECT *, CASE consumer_id WHEN 'c1' THEN last_ts - INTERVAL 1 DAY
                             WHEN 'c2' THEN last_ts + INTERVAL 1 HOUR END AS query_start
  FROM off0
)"""


def log(events):
    """A commit log in which each event committed the position it left; low values are tombstones."""
    return events.select(
        *OWNER,
        F.col("event_id").alias("commit_seq"),
        F.col("ts").alias("last_ts"),
        F.col("doc_id").alias("last_doc_id"),
        F.col("event_id").alias("total"),
        F.when(F.col("event_type") == "error", F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("query_start"),
        (F.col("value") < 10).alias("deleted"),
    )


LOG_SQL = """
log AS (
  SELECT consumer_id, index_name, event_id AS commit_seq, ts AS last_ts, doc_id AS last_doc_id,
         event_id AS total,
         CASE WHEN event_type = 'error' THEN ts - INTERVAL 1 HOUR END AS query_start,
         value < 10 AS deleted
  FROM ev
),
newest AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY consumer_id, index_name ORDER BY commit_seq DESC) = 1
),
latest AS (SELECT * FROM newest WHERE NOT deleted)"""


def ledger(events, least=10.0, epoch=0):
    """What has been handled: all but the events of low value."""
    return events.filter(F.col("value") >= least).select(
        *OWNER, "doc_id", "event_id", "ts", F.col("event_id").alias("commit_seq"), F.lit(epoch).alias("epoch")
    )


LED_SQL = """
led AS (SELECT consumer_id, index_name, doc_id, event_id, ts, event_id AS commit_seq FROM ev WHERE value >= 10)"""


def resent(events):
    """Copies of the later events, sent again ten seconds on with a raised value."""
    return (
        events.filter(F.col("ts") >= at(RESENT_FROM))
        .withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 SECONDS"))
        .withColumn("value", F.col("value") + 1)
    )


NEW_SQL = f"""
resent AS (
  SELECT * REPLACE (ts + INTERVAL 10 SECONDS AS ts, value + 1 AS value)
  FROM ev WHERE ts >= TIMESTAMP '{RESENT_FROM}'
)"""
