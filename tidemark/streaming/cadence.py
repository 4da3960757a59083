"""Commit points of a running stream: by count, by time, and by a timer when nothing more comes.

One keyed state per (consumer, index) holds when it last committed, how many events it has handled since and in all,
and the last of them. The points are those of :func:`tidemark.operators.cadence.commit_points_count_or_time` on the same
events, however the stream was cut into micro-batches and however often it was restarted.

In event time an event is final when the watermark has passed it: until then it waits in the state, so that late events
take their place in the order. In processing time events are taken as they come (sorted within a micro-batch).
A timer commits what has been handled when no event came for the interval. Such an idle commit saves the
position and leaves the cadence as it is; otherwise the points would depend on when batches are cut.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.functions.timestamps import micros
from tidemark.operators.cadence import BATCHED_COMMIT_EVERY, BATCHED_COMMIT_SECONDS
from tidemark.schemas import CONSUMER_KEY, OFFSETS
from tidemark.sources.store import OFFSET_TABLE, OffsetStore
from tidemark.streaming.pipeline import DISK_STORE, STATE_STORE

# What a row of the stream of points says besides its key: the event committed, the events in the commit, all handled so
# far, and why: count, time or idle.
POINT = "us long, doc_id string, n long, handled long, reason string"


def advance(us: np.ndarray, since: int, done: int, n: int, gap: int):
    """Commit points among the ordered times ``us``: [(place, events in the commit, reason)], and the state after.

    ``done`` events have been handled since the commit at ``since``. The next point is the ``n``-th event or the first one
    ``gap`` later, whichever comes first.
    """
    points, at = [], 0
    while True:
        by_count = at + n - done - 1
        by_time = max(at, int(np.searchsorted(us, since + gap, side="left")))
        place = min(by_count, by_time)
        if place >= len(us):
            return points, since, done + len(us) - at
        points.append((place, done + place - at + 1, "count" if by_count <= by_time else "time"))
        since, done, at = int(us[place]), 0, place + 1


class CommitCadence(StatefulProcessor):
    """The state of one (consumer, index)."""

    def __init__(self, n: int, seconds: float, keys: list[str], event_time: bool):
        self.n, self.gap, self.keys, self.event_time = n, int(seconds * 1_000_000), keys, event_time

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "since long, done long, handled long, saved long, us long, doc_id string")
        self.waiting = handle.getListState("waiting", "us long, doc_id string")

    def _rows(self, key, points):
        frame = pd.DataFrame(points, columns=["us", "doc_id", "n", "handled", "reason"])
        for place, name in enumerate(self.keys):
            frame.insert(place, name, key[place])
        return frame

    def _fold(self, key, frame):
        """Take final events, in order."""
        frame = frame.sort_values(["us", "doc_id"], kind="stable")
        us, ids = frame["us"].to_numpy(dtype=np.int64), frame["doc_id"].to_numpy()
        old = self.state.get() if self.state.exists() else None
        since, done, handled, saved = old[:4] if old else (int(us[0]), 0, 0, 0)
        points, since_after, done_after = advance(us, since, done, self.n, self.gap)
        out = [(int(us[p]), ids[p], k, handled + p + 1, why) for p, k, why in points]
        saved = out[-1][3] if out else saved
        self.state.update((since_after, done_after, handled + len(us), saved, int(us[-1]), ids[-1]))
        return out

    def _idle_at(self, timers):
        """Call back when the interval has passed without an event."""
        now = self.state.get()[4] if self.event_time else timers.getCurrentProcessingTimeInMs() * 1000
        self.handle.registerTimer(-(-(now + self.gap) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        frames = [f[["us", "doc_id"]] for f in rows]
        frame = pd.concat(frames, ignore_index=True)
        if self.event_time:
            self.waiting.appendList(list(zip(frame["us"].tolist(), frame["doc_id"].tolist(), strict=True)))
            self.handle.registerTimer(-(-int(frame["us"].min()) // 1000))
            return
        points = self._fold(key, frame)
        self._idle_at(timerValues)
        if points:
            yield self._rows(key, points)

    def _idle(self, key):
        since, done, handled, saved, us, doc_id = self.state.get()
        if handled == saved:
            return []
        self.state.update((since, done, handled, handled, us, doc_id))
        return [(us, doc_id, done, handled, "idle")]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        points = []
        if self.event_time:
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            held = sorted(self.waiting.get()) if self.waiting.exists() else []
            final = [e for e in held if e[0] <= mark]
            if final:
                points = self._fold(key, pd.DataFrame(final, columns=["us", "doc_id"]))
                left = held[len(final) :]
                if left:
                    self.waiting.put(left)
                    self.handle.registerTimer(-(-left[0][0] // 1000))
                else:
                    self.waiting.clear()
            if self.state.exists():
                # Events that still wait lie behind the watermark, so none of them falls into the interval.
                if self.state.get()[4] + self.gap <= mark:
                    points += self._idle(key)
                elif final:
                    self._idle_at(timerValues)
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            later = [t for t in self.handle.listTimers() if t > now]
            if not later:  # else events have come since this timer was set
                points = self._idle(key)
        if points:
            yield self._rows(key, points)

    def close(self):
        pass


def commit_points(
    stream: DataFrame,
    n: int = BATCHED_COMMIT_EVERY,
    seconds: float = BATCHED_COMMIT_SECONDS,
    keys=CONSUMER_KEY,
    delay: str | None = None,
    ts="timestamp",
    doc_id="doc_id",
) -> DataFrame:
    """(keys, us, doc_id, n, handled, reason): the commit points of a stream of events, as they become due.

    ``delay``: event time, with a watermark that far behind; without it processing time. Null keys are one key,
    events without a time have no place in the order and are left out. The state of a key is a few numbers and,
    in event time, the events of one ``delay``; it is kept on disk unless the session names another store.
    """
    if stream.sparkSession.conf.get(STATE_STORE, None) != DISK_STORE:
        stream.sparkSession.conf.set(STATE_STORE, DISK_STORE)  # the only kind of store that keeps timers
    keys = list(keys)
    events = stream.filter(F.col(ts).isNotNull())
    if delay is not None:
        events = events.withWatermark(ts, delay)
    # The watermark column itself must stay in the input.
    rows = events.select(*keys, F.col(ts), F.col(doc_id).cast("string").alias("doc_id"), micros(F.col(ts).cast("timestamp")).alias("us"))
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + T._parse_datatype_string(POINT).fields)
    processor = CommitCadence(n, seconds, keys, delay is not None)
    mode = "ProcessingTime" if delay is None else "EventTime"
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", mode)


def save_points(store: OffsetStore):
    """A writer of micro-batches of :func:`commit_points` (keys: consumer and index): each consumer's newest point becomes
    its offset record, numbered by the events handled up to it. A replayed batch writes the same directories."""

    def write(points: DataFrame, batch_id: int) -> None:
        newest = points.groupBy(*CONSUMER_KEY).agg(F.max_by(F.struct("us", "doc_id"), "handled").alias("at"), F.max("handled").alias("handled"))
        records = newest.select(
            *CONSUMER_KEY,
            F.timestamp_micros("at.us").alias("last_processed_timestamp"),
            F.col("at.doc_id").alias("last_processed_doc_id"),
            F.current_timestamp().alias("last_updated"),
            F.col("handled").alias("total_processed"),
            F.lit(None).cast("timestamp").alias("query_start_timestamp"),
            F.lit(None).cast("timestamp").alias("sought_timestamp"),
            F.lit(0).cast("long").alias("epoch"),
            F.lit(False).alias("deleted"),
            F.col("handled").alias("commit_seq"),
        ).select(*OFFSETS.fieldNames())
        (
            records.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*CONSUMER_KEY, "commit_seq")
            .parquet(store.path(OFFSET_TABLE))
        )

    return write


def commit_while_streaming(store: OffsetStore, stream: DataFrame, checkpoint: str, poll_seconds: float | None = None, **cadence) -> StreamingQuery:
    """Keep the offsets of every (consumer, index) of a stream, committing by count, by time, and when idle.

    This query is then the one writer of these consumers' records: an event counts as handled when it has come by.
    """
    trigger = {"availableNow": True} if poll_seconds is None else {"processingTime": f"{poll_seconds} seconds"}
    points = commit_points(stream, **cadence)
    return (
        points.writeStream.foreachBatch(save_points(store)).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
    )
