"""A named consumer that reads a growing table in batches and remembers how far it got."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions.text import CONSUMER_PREFIX, READ_ONLY_PREFIX
from tidemark.functions.timestamps import SAFETY_SECONDS, as_bound, micros
from tidemark.operators.dedup import dedup_events, drop_seen
from tidemark.operators.failures import prefix_before_failure
from tidemark.operators.fetch import BATCH_SIZE, ID_PREFIX, next_batch
from tidemark.plans.workspace import settle
from tidemark.sources.files import delete
from tidemark.sources.store import ATTEMPT, CommitConflict, OffsetStore, Position

# Fixed value: how often a commit is built anew because other writers were faster.
CONFLICT_TRIES = 20


class Batch:
    """One fetched batch: the events (written once, so every use sees the same rows) and its context.

    ``number`` is the commit number it will have unless another writer of the consumer commits first. ``deliver``
    writes a part of it to the sink, aside, and returns the paths that the commit moves.
    """

    def __init__(self, events: DataFrame, position: Position, attempt: int, number: int):
        self.events, self.position, self.attempt, self.number = events, position, attempt, number
        self.token, self.deliver = uuid.uuid4().hex, None


class Consumer:
    """Reads ``events()`` for one (consumer, index).

    With ``safety_seconds`` each read starts that much before the last position and leaves out what
    the ledger holds, so late events are met. With None it goes on exactly after the last event.
    ``batch_size`` None takes all that is pending in one distributed batch. Without a
    ``consumer_id`` a random one is made.
    """

    def __init__(
        self,
        store: OffsetStore,
        events: Callable[[], DataFrame],
        consumer_id: str | None,
        index_name: str,
        prefix: str | None = None,
        batch_size: int | None = BATCH_SIZE,
        safety_seconds: int | None = SAFETY_SECONDS,
        sink: str | None = None,
    ):
        self.store, self.events = store, events
        self.consumer_id = consumer_id or f"{CONSUMER_PREFIX}{uuid.uuid4().hex[:8]}"
        self.index_name = index_name
        self.prefix, self.batch_size, self.safety_seconds, self.sink = prefix, batch_size, safety_seconds, sink
        self.session_start = self.position().commit_seq + 1

    @classmethod
    def read_only(cls, store, events, index_name, consumer_id=None, prefix=ID_PREFIX, **options):
        """Documents of one id prefix, each exactly after the one before it."""
        name = consumer_id or f"{READ_ONLY_PREFIX}{index_name}"
        return cls(store, events, name, index_name, prefix=prefix, safety_seconds=None, **options)

    def position(self) -> Position:
        return self.store.load(self.consumer_id, self.index_name)

    def pending(self, position: Position | None = None) -> DataFrame:
        """All events due from ``position`` (default: the stored one), without a limit.

        An event without a time has no place in the order: it is not delivered, see :meth:`undated`.
        """
        at = position or self.position()
        events = self.events().filter(F.col("timestamp").isNotNull())
        if self.prefix:
            events = events.filter(P.has_prefix(F.col("doc_id"), self.prefix))
        ts, doc_id = F.col("timestamp"), F.col("doc_id")
        if self.safety_seconds is None:
            if at.doc_id is not None:
                return events.filter(P.after_position(ts, doc_id, as_bound(at.micros), F.lit(at.doc_id)))
            return events if at.is_new else events.filter(P.after(ts, as_bound(at.micros)))
        if at.is_new:
            return events
        start = at.safe_start - self.safety_seconds * 1_000_000
        start = start if at.floor is None else max(start, at.floor)
        bound = as_bound(start)
        handled = self.store.handled_by(self.consumer_id, self.index_name).filter(
            (F.col("epoch") == at.epoch) & (F.col("commit_seq") <= at.commit_seq) & P.after(ts, bound)
        )
        return drop_seen(events.filter(P.after(ts, bound)), handled, ["doc_id"])

    def undated(self) -> DataFrame:
        """Events that no read delivers, because they have no time."""
        return self.events().filter(F.col("timestamp").isNull())

    def poll(self) -> Batch:
        """Mark the read and fetch the next batch. Nothing moves until it is committed."""
        at = self.position()
        attempt = self.store.mark_start(self.consumer_id, self.index_name)
        # Copies merge before the limit, so a batch of n holds n events.
        events = next_batch(dedup_events(self.pending(at)), self.batch_size)
        return Batch(settle(events, "batch"), at, attempt, at.commit_seq + 1)

    def commit(self, batch: Batch, done: DataFrame | None = None) -> Position:
        """Record ``done`` (default: the whole batch) as handled and move the position.

        Sink, ledger and offset become visible together. If another writer of this consumer has committed since the
        batch was polled, what it handled is taken out of this batch and the rest is committed after it; a batch
        polled before a seek is not committed (:class:`CommitConflict`). Running it again for the same batch changes
        nothing.
        """
        me = self.consumer_id, self.index_name
        finished = batch.events if done is None else done
        whole, before = done is None, batch.position
        for _ in range(CONFLICT_TRIES):
            newest = F.max(F.struct(micros(F.col("timestamp")).alias("us"), F.col("doc_id").alias("id")))
            row = finished.agg(newest.alias("top"), F.count(F.lit(1)).alias("n")).first()
            if row.n == 0:
                self._discard(batch)
                if whole:
                    self.store.clear_start(*me, batch.attempt)
                return before
            whole = whole or row.n == batch.events.count()
            top = (row.top.us, row.top.id)
            if not before.is_new and (before.micros, before.doc_id or "") > top:
                top = (before.micros, before.doc_id)
            batch.number = before.commit_seq + 1
            after = before._replace(micros=top[0], doc_id=top[1], total=before.total + row.n, query_start=None, commit_seq=batch.number)
            moves = [self.store.stage_handled(*me, batch.number, finished, before.epoch, batch.token)]
            if self.sink is not None and batch.deliver is not None:
                moves.append((self._aside(batch), f"{self.sink}/commit_seq={batch.number}"))
            if self.store.publish(*me, before, after, batch.token, moves):
                if whole:
                    self.store.clear_start(*me, batch.attempt)
                return after
            now = self.position()
            if now.epoch != before.epoch:
                self._discard(batch)
                raise CommitConflict(f"{self.consumer_id} was sent to another position while a batch was being handled")
            handled = self.store.handled_by(*me, ids=finished).filter((F.col("epoch") == now.epoch) & (F.col("commit_seq") <= now.commit_seq))
            finished, before = settle(drop_seen(finished, handled, ["doc_id"]), "rest"), now
            if batch.deliver is not None:
                batch.deliver(finished)
        raise CommitConflict(f"other writers of {self.consumer_id} were faster {CONFLICT_TRIES} times")

    def _aside(self, batch: Batch) -> str:
        return f"{self.sink}/{ATTEMPT}{batch.token}"

    def _discard(self, batch: Batch) -> None:
        """Remove what an attempt has written aside."""
        delete(self.store.spark, self.store.attempt_path("ledger", self.consumer_id, self.index_name, batch.token))
        if self.sink is not None:
            delete(self.store.spark, self._aside(batch))

    def consume(
        self,
        process: Callable[[DataFrame], DataFrame] | None = None,
        ok: Column | None = None,
        commit: bool = True,
    ) -> Batch:
        """Poll, run ``process`` on the batch, write the sink aside, commit.

        ``ok`` says which events succeed; from the first that does not, the rest is left for the
        next read and the attempt stays open. With ``commit=False`` the caller commits later; until
        then the same events are fetched again.
        """
        batch = self.poll()
        done = batch.events
        if ok is not None:
            whole = F.lit(self.consumer_id).alias("_whole")
            kept = prefix_before_failure(done.select("*", whole), ok, ("_whole",)).drop("_whole")
            done = settle(kept, "done")
        if self.sink is not None:
            batch.deliver = lambda df: (process(df) if process else df).write.mode("overwrite").parquet(self._aside(batch))
            batch.deliver(done)
        elif process is not None:
            process(done).write.format("noop").mode("overwrite").save()
        if commit:
            self.commit(batch, None if ok is None else done)
        return batch

    def drain(self, process=None, most: int | None = None) -> int:
        """Consume until nothing is pending (or ``most`` batches). Returns the batches done."""
        done = 0
        while most is None or done < most:
            if self.consume(process).events.isEmpty():
                break
            done += 1
        return done

    def seek(self, to) -> Position:
        """Everything later than ``to`` is delivered again; the total is kept."""
        return self.store.seek(self.consumer_id, self.index_name, to)

    def reset(self) -> Position:
        return self.store.reset(self.consumer_id, self.index_name)

    def backlog(self) -> DataFrame:
        """Events not yet committed and seconds since the last commit (null before the first), as one row."""
        seconds = self.store.seconds_since_commit(self.consumer_id, self.index_name)
        return self.pending().agg(F.countDistinct("doc_id").alias("uncommitted")).withColumn(
            "seconds_since_commit", F.lit(seconds).cast("double")
        )

    def status(self) -> DataFrame:
        """Id, index, session and lifetime totals, and the last position, as one row."""
        return self.store.status(self.consumer_id, self.index_name, self.session_start)
