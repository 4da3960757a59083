"""Filters of the incremental read. All stay plain comparisons, so the scan can use them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def after(ts: Column, bound: Column) -> Column:
    return ts > bound


def after_position(ts: Column, doc_id: Column, last_ts: Column, last_id: Column) -> Column:
    """Strictly after the event (last_ts, last_id) in (time, id) order.

    ``ts >= last_ts`` follows from the rest; it is there because it alone can be pushed down.
    """
    return (ts >= last_ts) & ((ts > last_ts) | (doc_id > last_id))


def resume_or_first(ts: Column, doc_id: Column, last_ts: Column, last_id: Column) -> Column:
    """One predicate for consumers with and without a stored position.

    No time: everything. A time but no id (after a seek): strictly later. Both: keyset.
    """
    return last_ts.isNull() | (ts > last_ts) | ((ts == last_ts) & (doc_id > last_id))


def has_prefix(doc_id: Column, prefix: str) -> Column:
    return doc_id.startswith(prefix)


def other_than(doc_id: Column, last_id) -> Column:
    """Not the last processed document; no restriction when there is none."""
    if last_id is None or last_id == "":
        return F.lit(True)
    return doc_id != F.lit(last_id)
