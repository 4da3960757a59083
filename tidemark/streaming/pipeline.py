"""A consumer as a streaming query.

Spark's checkpoint decides what has been read. Each micro-batch writes its part of the sink, the ledger and the
offset log aside and then publishes them together: a replayed batch replaces what its first attempt
left, or is passed over if that was published, so every event counts once.
"""

import hashlib
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions import predicates as P
from tidemark.functions.timestamps import as_bound, micros
from tidemark.operators.cadence import REPORT_EVERY
from tidemark.operators.dedup import dedup_events, drop_seen
from tidemark.plans.positions import with_position
from tidemark.plans.workspace import fresh_path, prepare, settle
from tidemark.schemas import EVENT_ORDER
from tidemark.sources.files import delete
from tidemark.sources.store import ATTEMPT, OFFSET_TABLE, CommitConflict, OffsetStore, Position

# Retry of a commit, wait after a failed loop, polling interval.
COMMIT_TRIES = 3
COMMIT_DELAY_SECONDS = 1.0
RESTART_WAIT_SECONDS = 5.0
POLL_SECONDS = 2

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
MEMORY_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
DISK_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The name under which a pipeline's events are counted while they pass.
EVENTS_METRIC = "tidemark_events"
# A micro-batch has at most so many parts.
PARTS_SPAN = 1_000_000_000
# Row-exact parts whose files are written together: so many parts, and about so many rows.
PARTS_AT_ONCE = 1_000
ROWS_AT_ONCE = 5_000_000
# A part's rows go to one task for each so many of them.
ROWS_A_TASK = 250_000
# Commits of epoch e of a stream are numbered from e * EPOCH_SPAN or, if others got further, from there.
EPOCH_SPAN = 1_000_000_000


def with_backoff(action: Callable, tries=COMMIT_TRIES, delay=COMMIT_DELAY_SECONDS, sleep=time.sleep):
    """Run ``action``; on failure wait and try again, twice as long each time. The last failure is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            return action()
        except Exception:
            if left == 0:
                raise
            sleep(delay)
            delay *= 2


class PositionMoved(RuntimeError):
    """A seek or reset: what this query was reading is no longer what is due."""


def run_to_end(start: Callable[[], StreamingQuery], restarts=3, wait=RESTART_WAIT_SECONDS, sleep=time.sleep, ends=lambda: False) -> int:
    """Run a query to its end, restarting a failed one from its checkpoint. Returns the restarts used. ``ends()``
    says that a failure is no reason to try again."""
    used = 0
    while True:
        try:
            start().awaitTermination()
            return used
        except StreamingQueryException:
            if used >= restarts or ends():
                raise
            used += 1
            sleep(wait)


def dedup_stream(stream: DataFrame, delay: str, key=("doc_id",), ts="timestamp") -> DataFrame:
    """One copy of each event within ``delay`` of event time. State older than that is dropped.

    The watermark bounds the state; it is not an exact cut for late rows. The state grows with the
    events of one ``delay``, so it is kept on disk unless the session names another store.
    """
    if stream.sparkSession.conf.get(STATE_STORE, None) in (None, MEMORY_STORE):
        stream.sparkSession.conf.set(STATE_STORE, DISK_STORE)
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


class ProgressMarks(StreamingQueryListener):
    """Calls ``report(total)`` for each multiple of ``every`` that a query's events pass.

    A pipeline's own count is taken, of the events after its filters; of another query, its input rows. A micro-batch
    counts once, also if it is replayed or the query restarts. ``handled`` events came before this listener began.
    """

    def __init__(self, report: Callable[[int], None], every: int = REPORT_EVERY, handled: int = 0):
        self.report, self.every, self.handled, self.totals, self.seen = report, every, handled, {}, {}

    def onQueryStarted(self, event):
        self.totals.setdefault(event.id, self.handled)

    def onQueryProgress(self, event):
        progress = event.progress
        if progress.batchId <= self.seen.get(progress.id, -1):
            return
        observed = progress.observedMetrics.get(EVENTS_METRIC)
        before = self.totals.get(progress.id, self.handled)
        after = before + (progress.numInputRows if observed is None else observed.n)
        self.seen[progress.id], self.totals[progress.id] = progress.batchId, after
        for mark in range(before // self.every + 1, after // self.every + 1):
            self.report(mark * self.every)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


class EventPipeline:
    """Processes a stream for one (consumer, index).

    ``dedup_delay`` keeps one copy of each event within that delay. ``safety_seconds`` leaves out
    events that come more than that behind the stored position, as a batch read would.
    ``skip_handled`` leaves out whatever the ledger holds, however old: no state, and copies of one
    event merge before the shuffle. ``batch_rows`` delivers and commits at most so many events at a time,
    in order, however many a micro-batch has.
    """

    def __init__(
        self,
        store: OffsetStore,
        consumer_id: str,
        index_name: str,
        sink: str,
        checkpoint: str,
        process: Callable[[DataFrame], DataFrame] | None = None,
        prefix: str | None = None,
        dedup_delay: str | None = None,
        safety_seconds: int | None = None,
        skip_handled: bool = False,
        batch_rows: int | None = None,
    ):
        self.store, self.consumer_id, self.index_name = store, consumer_id, index_name
        self.sink, self.process, self.prefix, self.dedup_delay = sink, process, prefix, dedup_delay
        self.safety_seconds, self.skip_handled, self.batch_rows = safety_seconds, skip_handled, batch_rows
        self.checkpoints, self.session_start = checkpoint, store.load(consumer_id, index_name).commit_seq + 1
        self.open()

    def open(self) -> None:
        """Take up the stored position. A seek raises the epoch and so begins a new checkpoint; restarts keep the old one."""
        at = self.store.load(self.consumer_id, self.index_name)
        self.epoch, self.floor, self.moved, self.overtaken = at.epoch, at.floor, False, False
        self.checkpoint = f"{self.checkpoints}/epoch={self.epoch}"
        # The checkpoint is the writer: a new one begins at the stored position, a known one where it left off.
        self.writer = hashlib.sha256(self.checkpoint.encode()).hexdigest()[:16]
        self.began = self.store.starting_point(self.consumer_id, self.index_name, self.writer)

    def shape(self, stream: DataFrame) -> DataFrame:
        if self.prefix:
            stream = stream.filter(P.has_prefix(F.col("doc_id"), self.prefix))
        # An event without a time has no place in the order of events.
        stream = stream.filter(F.col("timestamp").isNotNull())
        if self.floor is not None:
            stream = stream.filter(P.after(F.col("timestamp"), as_bound(self.floor)))
        if self.began.doc_id is not None and not self.skip_handled:
            at = as_bound(self.began.micros), F.lit(self.began.doc_id)
            stream = stream.filter(P.after_position(F.col("timestamp"), F.col("doc_id"), *at))
        stream = dedup_stream(stream, self.dedup_delay) if self.dedup_delay else stream
        return stream.observe(EVENTS_METRIC, F.count(F.lit(1)).alias("n"))

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """The whole effect of one micro-batch; safe to repeat. With ``batch_rows``, its events by time and id, so many
        at a time, each part committed before the next. Parts are cut before anything is compared with
        the ledger, so a replay cuts the same ones and passes over those that were committed."""
        first = batch_id * PARTS_SPAN
        if self.batch_rows is None:
            self._handle(batch, first)
            return
        if self.skip_handled:
            batch = dedup_events(batch)
        whole = batch.withColumn("_whole", F.lit(0))
        ordered = settle(with_position(whole, ["_whole"], EVENT_ORDER, "_row").drop("_whole"), "rows")
        parts = -(-ordered.count() // self.batch_rows)
        together = max(1, min(PARTS_AT_ONCE, ROWS_AT_ONCE // self.batch_rows))
        for part in range(0, parts, together):
            self._handle_parts(ordered, first, part, min(part + together, parts))

    def _now(self) -> Position:
        """The stored position. If it was moved (a seek, a reset), the query ends: see :meth:`follow`."""
        now = self.store.load(self.consumer_id, self.index_name)
        if now.epoch != self.epoch:
            self.moved = True
            raise PositionMoved(f"{self.consumer_id} was sent to another position")
        return now

    def _due(self, batch: DataFrame, before: Position) -> DataFrame:
        """What of ``batch`` is not too late and has not been handled."""
        if self.safety_seconds is not None and before.doc_id is not None:
            cut = before.micros - self.safety_seconds * 1_000_000
            batch = batch.filter(P.after(F.col("timestamp"), as_bound(cut)))
        if self.skip_handled:
            handled = self.store.handled_by(self.consumer_id, self.index_name, ids=batch).filter(F.col("epoch") == self.epoch)
            batch = drop_seen(dedup_events(batch), handled, ["doc_id"])
        return batch

    def _after(self, before: Position, top, n: int) -> Position:
        """The position once ``n`` events have been handled, the newest of them ``top``."""
        top = (top.us, top.id)
        if not before.is_new and (before.micros, before.doc_id or "") > top:
            top = (before.micros, before.doc_id)
        number = max(before.commit_seq + 1, self.epoch * EPOCH_SPAN)
        return before._replace(micros=top[0], doc_id=top[1], total=before.total + n, query_start=None, epoch=self.epoch, commit_seq=number)

    def _publish(self, before: Position, after: Position, step: int, moves, record: str | None = None) -> None:
        me, token = (self.consumer_id, self.index_name), f"{self.writer}-{step}"
        if not with_backoff(lambda: self.store.publish(*me, before, after, token, moves, (self.writer, step), record=record)):
            self._now()
            self.overtaken = True
            raise CommitConflict(f"another writer of {self.consumer_id} committed during step {step}")

    def _handle_parts(self, ordered: DataFrame, first: int, begin: int, end: int) -> None:
        """Deliver and commit the parts from ``begin`` to before ``end``, one after the other.

        What is written for them (sink, ledger, records) is written aside by one job each for all parts, a folder a part; a
        commit then only moves its folders, so it costs the same whatever has been committed before. With a
        ``process``, which sees one part at a time, the sink takes a job a part.
        """
        me, spark = (self.consumer_id, self.index_name), self.store.spark
        token = f"{self.writer}-{first + begin}"
        # A replay goes on after the last part that was committed.
        begin = max(begin, self.store.last_step(*me, self.writer) - first + 1)
        if begin >= end:
            return
        before, row = self._now(), F.col("_row") - 1
        batch = self._due(ordered.filter(row.between(begin * self.batch_rows, end * self.batch_rows - 1)), before)
        staged = f"{self.sink}/{ATTEMPT}{token}"
        rows = f"{fresh_path(prepare(spark), 'parts')}" if self.process else staged
        placed = batch.withColumn("_part", F.floor(row / self.batch_rows)).repartition("_part", F.floor(row / ROWS_A_TASK))
        laid = placed.sortWithinPartitions("_part", "_row").drop("_row")
        laid.write.mode("overwrite").partitionBy("_part").parquet(rows)
        try:
            batch = spark.read.schema(laid.schema).parquet(rows)
            newest = F.max(F.struct(micros(F.col("timestamp")).alias("us"), F.col("doc_id").alias("id")))
            # A row for each part.
            found = batch.groupBy("_part").agg(newest.alias("top"), F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
            if found:
                ledger = with_backoff(lambda: self.store.stage_handled_parts(*me, batch, self.epoch, token, "_part"))
                positions, at = [], before
                for part in found:
                    at = self._after(at, part.top, part.n)
                    positions.append(at)
                records = with_backoff(lambda: self.store.stage_records(*me, positions, token))
                for part, after, record in zip(found, positions, records, strict=True):
                    folder = f"_part={part['_part']}"
                    if self.process:
                        one = spark.read.schema(ordered.drop("_row").schema).parquet(f"{rows}/{folder}")
                        self.process(one).write.mode("overwrite").parquet(f"{staged}/{folder}")
                    self.after_sink(first // PARTS_SPAN)
                    moves = [
                        (f"{ledger}/{folder}", self.store.handled_path(*me, after.commit_seq)),
                        (f"{staged}/{folder}", f"{self.sink}/batch_id={after.commit_seq}"),
                    ]
                    self._publish(before, after, first + part["_part"], moves, record)
                    before = after
        finally:
            if self.process:
                delete(spark, rows)
        # Only what no commit has moved: the folders themselves.
        for path in (staged, *(self.store.attempt_path(t, *me, token) for t in ("ledger", OFFSET_TABLE))):
            delete(spark, path)

    def _handle(self, batch: DataFrame, step: int) -> None:
        """Deliver and commit the events of one step.

        A step that has been committed is passed over. If the position was moved, nothing is written. If another writer
        commits in between, the batch fails and is replayed.
        """
        me = self.consumer_id, self.index_name
        if self.store.has_step(*me, self.writer, step):
            return
        before = self._now()
        batch = self._due(batch, before)
        # Written once, so that the sink, the ledger and the position come from the same rows without keeping
        # an unbounded batch on the executors.
        token = f"{self.writer}-{step}"
        aside, staged = fresh_path(prepare(self.store.spark), "micro-batch"), f"{self.sink}/{ATTEMPT}{token}"
        batch.write.parquet(aside)
        batch = self.store.spark.read.schema(batch.schema).parquet(aside)
        try:
            result = self.process(batch) if self.process else batch
            result.write.mode("overwrite").parquet(staged)
            self.after_sink(step // PARTS_SPAN)
            newest = F.max(F.struct(micros(F.col("timestamp")).alias("us"), F.col("doc_id").alias("id")))
            row = batch.agg(newest.alias("top"), F.count(F.lit(1)).alias("n")).first()
            if row.n == 0:
                delete(self.store.spark, staged)
                return
            after = self._after(before, row.top, row.n)
            handled = with_backoff(lambda: self.store.stage_handled(*me, after.commit_seq, batch, self.epoch, token))
        finally:
            delete(self.store.spark, aside)
        self._publish(before, after, step, [handled, (staged, f"{self.sink}/batch_id={after.commit_seq}")])

    def after_sink(self, batch_id: int) -> None:
        """Called between the sink write and the commit records. Tests fail here."""

    def status(self) -> DataFrame:
        """As the batch consumer's; how fast it runs is in the query's ``lastProgress``."""
        return self.store.status(self.consumer_id, self.index_name, self.session_start)

    def start(self, stream: DataFrame, poll_seconds: float | None = None) -> StreamingQuery:
        """Start the query: to the end of what is there, or polling when ``poll_seconds`` is given."""
        trigger = {"availableNow": True} if poll_seconds is None else {"processingTime": f"{poll_seconds} seconds"}
        return (
            self.shape(stream)
            .writeStream.foreachBatch(self.write_batch)
            .option("checkpointLocation", self.checkpoint)
            .trigger(**trigger)
            .start()
        )

    def run(self, make_stream: Callable[[], DataFrame], restarts=3, wait=RESTART_WAIT_SECONDS) -> int:
        """Process what is there, restarting after failures and, without counting it, after a seek."""
        while True:
            try:
                return run_to_end(lambda: self.start(make_stream()), restarts, wait, ends=lambda: self.moved)
            except StreamingQueryException:
                if not self.moved:
                    raise
                self.open()

    def follow(self, make_stream: Callable[[], DataFrame], poll_seconds: float = POLL_SECONDS, stop=lambda: False) -> None:
        """Poll on and on, until ``stop()``. A seek or reset reaches the running query: it ends, and a new one with a
        checkpoint of its own begins at the new position. Looked for between batches too, so that an idle stream
        meets it."""
        while not stop():
            query = self.start(make_stream(), poll_seconds)
            try:
                while not query.awaitTermination(poll_seconds):
                    if stop() or self.store.load(self.consumer_id, self.index_name).epoch != self.epoch:
                        break
            except StreamingQueryException:
                if not (self.moved or self.overtaken):
                    raise
            finally:
                query.stop()
            if not stop():
                self.open()
