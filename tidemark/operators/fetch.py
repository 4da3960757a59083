"""Bounded, time-ordered reads after a position."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions.timestamps import as_bound, back_off
from tidemark.operators.dedup import drop_seen
from tidemark.operators.marks import (
    as_rank_marks,
    bucket_counts,
    in_hours,
    look_at,
    marks_by,
    milestones,
    since,
    slot_of_event,
    slot_of_mark,
    with_bucket,
)
from tidemark.plans.positions import events_up_to, with_position
from tidemark.plans.topk import first_k
from tidemark.plans.workspace import settle
from tidemark.schemas import EVENT_ORDER

# The batch size and id prefix a consumer uses unless told otherwise.
BATCH_SIZE = 50
ID_PREFIX = "completion_"


def next_batch(events: DataFrame, k=BATCH_SIZE, order=EVENT_ORDER) -> DataFrame:
    """The first ``k`` events in time order; all of them, unsorted, when ``k`` is None."""
    return events if k is None else events.orderBy(*order).limit(k)


def fetch_first_run(events, prefix=ID_PREFIX, k=BATCH_SIZE, order=EVENT_ORDER, doc_id="doc_id") -> DataFrame:
    """A consumer without a position: matching ids only, no time bound."""
    return next_batch(events.filter(P.has_prefix(F.col(doc_id), prefix)), k, order)


def fetch_resume(
    events, last_ts, last_id=None, prefix=ID_PREFIX, k=BATCH_SIZE, order=EVENT_ORDER, doc_id="doc_id"
) -> DataFrame:
    """Events after the stored position.

    With ``last_id`` the position is one event, so a batch may end among equal timestamps and the
    next one goes on there. Without it the bound is strictly later than ``last_ts``.
    """
    ts, tie = F.col(order[0]), F.col(order[1])
    bound = as_bound(last_ts, events.schema[order[0]].dataType)
    later = P.after(ts, bound) if last_id is None else P.after_position(ts, tie, bound, F.lit(last_id))
    if prefix:
        later = later & P.has_prefix(F.col(doc_id), prefix)
    return next_batch(events.filter(later), k, order)


def fetch_safety_window(
    events, seen, start, last_id=None, k=BATCH_SIZE, seconds=30, order=EVENT_ORDER, doc_id="doc_id", seen_on=("doc_id",)
) -> DataFrame:
    """Read again from a little before ``start`` and skip what was handled.

    Seen events are dropped before the limit: they must not use up the batch. Of the ledger only
    the rows of the window are read.
    """
    bound = back_off(as_bound(start, events.schema[order[0]].dataType), seconds)
    if order[0] in seen.columns:
        seen = seen.filter(P.after(F.col(order[0]), bound))
    window = events.filter(P.after(F.col(order[0]), bound) & P.other_than(F.col(doc_id), last_id))
    return next_batch(drop_seen(window, seen, seen_on), k, order)


def fetch_after_seq(events, last_seq, k=BATCH_SIZE, seq="seq") -> DataFrame:
    """Resume on a single increasing number instead of on time."""
    return next_batch(events.filter(F.col(seq) > F.lit(last_seq)), k, (seq,))


def pending_per_consumer(
    events: DataFrame, offsets: DataFrame, k=BATCH_SIZE, order=EVENT_ORDER, index="index_name", max_marks=None
) -> DataFrame:
    """The next ``k`` events of every consumer over the index it reads, numbered by ``rn``.

    ``offsets``: consumer_id, ``index``, last_ts, last_id; a null last_ts is a first run. Consumers
    of one index share its events.
    """
    offsets = settle(with_bucket(offsets.select("consumer_id", index, "last_ts", "last_id")), "offsets")
    positions = look_at(offsets, [index])
    ahead = since(events, positions.earliest, order)
    hours = milestones(bucket_counts(ahead.select(index, order[0]), order, index), offsets, index)
    # An hour is read if a consumer stands in it, or if the hours between it and the last such hour
    # do not yet hold k events.
    near = hours.filter((F.col("n") > 0) & (F.col("is_mark") | (F.col("up_to") - F.col("n") - F.col("anchor") < k)))
    ahead = in_hours(ahead, settle(near.select(index, "bucket"), "hours"), order, index).drop("bucket")
    if positions.bounded(max_marks):
        return _pending_by_slot(ahead, offsets, k, order, index)
    return _pending_by_rank(settle(ahead, "ahead"), offsets, k, order, index)


def _pending_by_slot(events, offsets, k, order, index):
    # Each event falls into one slot: the number of positions of its index that lie before it. A
    # consumer wants the first k events of all slots from its own on, so k per slot is enough, and
    # no event is paired with every consumer.
    marks = F.broadcast(marks_by(offsets, [index]))
    placed = events.join(marks, index).withColumn("slot", slot_of_event(order)).drop("marks")
    candidates = first_k(placed, [index, "slot"], order, k).drop("rn")
    wanted = offsets.join(marks, index).select("consumer_id", index, slot_of_mark().alias("from_slot"))
    mine = candidates.join(F.broadcast(wanted), index).filter(F.col("slot") >= F.col("from_slot"))
    w = W.partitionBy("consumer_id", index).orderBy(*order)
    return mine.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("slot", "from_slot")


def _pending_by_rank(events, offsets, k, order, index):
    # Number the events of each index once; a position becomes a rank and its batch a rank range.
    before = events_up_to(events, as_rank_marks(offsets, [index], order), [index], order, ["consumer_id"])
    wanted = before.select(
        "consumer_id", index, F.posexplode(F.sequence(F.col("before") + 1, F.col("before") + k)).alias("rn", "_rank")
    ).withColumn("rn", F.col("rn") + 1)
    ranked = with_position(events, [index], order, "_rank")
    return ranked.join(wanted, [index, "_rank"]).drop("_rank")
