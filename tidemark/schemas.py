"""Declared schemas. Nothing in the library infers a schema from data."""

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("queryid", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)

OFFSETS = T.StructType(
    [
        T.StructField("consumer_id", T.StringType(), False),
        T.StructField("index_name", T.StringType(), False),
        T.StructField("last_processed_timestamp", T.TimestampType()),
        T.StructField("last_processed_doc_id", T.StringType()),
        T.StructField("last_updated", T.TimestampType()),
        T.StructField("total_processed", T.LongType()),
        T.StructField("query_start_timestamp", T.TimestampType()),
        T.StructField("sought_timestamp", T.TimestampType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("commit_seq", T.LongType()),
    ]
)

# Reads that were begun and not finished; a row goes when its batch is done.
ATTEMPTS = T.StructType(
    [
        T.StructField("consumer_id", T.StringType(), False),
        T.StructField("index_name", T.StringType(), False),
        T.StructField("attempt", T.LongType()),
        T.StructField("at", T.TimestampType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("consumer_id", T.StringType(), False),
        T.StructField("index_name", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("commit_seq", T.LongType()),
    ]
)

# The columns that identify one consumer's progress over one index.
CONSUMER_KEY = ("consumer_id", "index_name")

# Time order with a tie-break, so every ordered read is repeatable.
EVENT_ORDER = ("timestamp", "doc_id")


def same_columns(actual, declared):
    """True when both schemas hold the same column names and types, in any order."""
    return {f.name: f.dataType for f in actual.fields} == {f.name: f.dataType for f in declared.fields}
