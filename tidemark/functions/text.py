"""Keys, ids and rendered lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts consumers and producers write.
EVENT_LINE = "Processing event: %s - Type: %s - User: %s - Data: %s"
PAYLOAD = "Sample data for %s event by %s at %s"
CONSUMER_PREFIX = "consumer-"
READ_ONLY_PREFIX = "readonly-consumer-"


def offset_key(consumer_id: Column, index_name: Column) -> Column:
    """For display only: records are kept by the two columns, since 'a_b'+'c' equals 'a'+'b_c'."""
    return F.concat_ws("_", consumer_id, index_name)


def event_line(doc_id: Column, event_type: Column, user_id: Column, data: Column) -> Column:
    return F.format_string(EVENT_LINE, doc_id, event_type, user_id, data)


def payload(event_type: Column, user_id: Column, at_text: Column) -> Column:
    return F.format_string(PAYLOAD, event_type, user_id, at_text)


def content_id(*parts: Column) -> Column:
    """An id that a replay reproduces: a hash of the content, with null told apart from ''."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)


def random_id() -> Column:
    return F.uuid()


def random_consumer_id() -> Column:
    return F.concat(F.lit(CONSUMER_PREFIX), F.substring(F.uuid(), 1, 8))


def write_outcome(existing_id: Column) -> Column:
    """What writing a document did, from the id it met in the table."""
    return F.when(existing_id.isNull(), "created").otherwise("updated")
