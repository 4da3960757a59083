"""The offset store: an append-only commit log, marks of open reads and the ledger of handled events.

Each write is one directory named after what it records (consumer, index, commit number), so
writing it again replaces it, and consumers never write to each other's directories. Nothing is
updated in place; current values are views over the log.

All writers of one (consumer, index), batch or stream, build on one chain of commits. A commit is written aside and
becomes visible by one file that only one writer can create (:meth:`OffsetStore.publish`); who comes second
sees the record of who came first.
Compaction gathers the rows of old commits in one directory, each with its number, and never drops one:
rows up to the number in the newest such directory's name are read from there, later ones from their own.
"""

import json
import math
import re
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timestamps import as_bound, display_text, effective_start, micros, safe_start, to_instant
from tidemark.operators import offsets as ops
from tidemark.operators.reports import table_stats
from tidemark.plans.workspace import prepare
from tidemark.schemas import ATTEMPTS, CONSUMER_KEY, LEDGER, OFFSETS
from tidemark.sources.files import child_names, create_with, delete, drop_stale, exists, make, move_once, read_text, rename

# Fixed value: the name of the offset table.
OFFSET_TABLE = "consumer_offsets"
# Folders of commits that are not published yet; Spark's readers pass over names that begin like this.
ATTEMPT = "_attempt-"
# Compaction: rows per file, the age at which an attempt counts as given up, heads that stay.
ROWS_PER_FILE = 1_000_000
STALE_SECONDS = 86_400
KEPT_HEADS = 1_000


class CommitConflict(RuntimeError):
    """Another writer of the same consumer has moved its position meanwhile."""


class Position(NamedTuple):
    """One consumer's current record. Times are epoch microseconds; the epoch is 0."""

    micros: int
    doc_id: str | None
    total: int
    query_start: int | None
    epoch: int
    commit_seq: int
    floor: int | None = None  # the time last sought to: nothing up to it is due in this epoch

    @property
    def is_new(self) -> bool:
        return self.doc_id is None and self.floor is None

    @property
    def safe_start(self) -> int:
        """Where the next read may begin without passing over unprocessed events."""
        return self.micros if self.query_start is None else min(self.micros, self.query_start)


def _part(name, value) -> str:
    # Same escaping as Spark's own partition directories.
    escaped = re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m.group()):02X}", str(value))
    return f"{name}={escaped}"


def _merged(table: str) -> str:
    return f"{table}_merged"


def _merged_schema(schema) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(c, T.LongType()) for c in ("upto", "buckets", "bucket")]])


def _bucket(buckets: int):
    """Where compaction puts a ledger row: by the hash of its id alone."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("long")


class OffsetStore:
    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = ROWS_PER_FILE):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self.bucket_rows = bucket_rows

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str, schema) -> DataFrame:
        path = self.path(table)
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _folder(self, table: str, consumer_id, index_name) -> str:
        return "/".join([self.path(table), _part("consumer_id", consumer_id), _part("index_name", index_name)])

    def _mine(self, table: str, schema, consumer_id, index_name) -> DataFrame:
        """One consumer's rows, listing only its own directories."""
        folder = self._folder(table, consumer_id, index_name)
        if not exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(folder)

    def _upto(self, table: str, consumer_id, index_name) -> int:
        """The newest commit number that compaction has gathered; below all numbers if none."""
        return max(self._numbers(self._folder(_merged(table), consumer_id, index_name), "upto"), default=-1)

    def _all(self, table: str, schema) -> DataFrame:
        """Every consumer's rows of a compacted table."""
        rows = self._read(table, schema).select(*schema.fieldNames())
        if not exists(self.spark, self.path(_merged(table))):
            return rows
        merged = self._read(_merged(table), _merged_schema(schema))
        # One row for each compacted consumer.
        newest = merged.groupBy(*CONSUMER_KEY).agg(F.max("upto").alias("_newest"))
        gathered = merged.join(newest, list(CONSUMER_KEY)).filter(F.col("upto") == F.col("_newest"))
        later = rows.join(newest, list(CONSUMER_KEY), "left").filter(F.col("commit_seq") > F.coalesce("_newest", F.lit(-1)))
        return gathered.select(*rows.columns).unionByName(later.select(*rows.columns))

    def _parts(self, table: str, schema, consumer_id, index_name) -> tuple[DataFrame, DataFrame | None]:
        """One consumer's rows of commits of their own, and those that compaction has gathered (with their bucket)."""
        rows = self._mine(table, schema, consumer_id, index_name).select(*schema.fieldNames())
        upto = self._upto(table, consumer_id, index_name)
        if upto < 0:
            return rows, None
        merged = self._mine(_merged(table), _merged_schema(schema), consumer_id, index_name).filter(F.col("upto") == upto)
        return rows.filter(F.col("commit_seq") > upto), merged

    def _all_mine(self, table: str, schema, consumer_id, index_name) -> DataFrame:
        rows, merged = self._parts(table, schema, consumer_id, index_name)
        return rows if merged is None else merged.select(*rows.columns).unionByName(rows)

    def _one_row(self) -> DataFrame:
        return self.spark.range(0, 1, 1, 1)

    def _numbers(self, folder: str, name: str) -> list[int]:
        return [int(n.split("=")[1]) for n in child_names(self.spark, folder) if n.startswith(f"{name}=")]

    def _inner(self, schema, name) -> T.StructType:
        return T.StructType([f for f in schema.fields if f.name not in ("consumer_id", "index_name", name)])

    def _write(self, df: DataFrame, table: str, schema, consumer_id, index_name, number) -> None:
        target = f"{self._folder(table, consumer_id, index_name)}/{_part('commit_seq', number)}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._inner(schema, "commit_seq").fields]
        df.select(*columns).write.mode("overwrite").parquet(target)

    # --- views

    def log(self) -> DataFrame:
        return self._all(OFFSET_TABLE, OFFSETS)

    def stats(self) -> DataFrame:
        """Records and stored bytes of the offset table."""
        sizes = [self.spark.sql("SELECT 0L AS docs, 0L AS bytes")]
        for table in (OFFSET_TABLE, _merged(OFFSET_TABLE)):
            if exists(self.spark, self.path(table)):
                sizes.append(table_stats(self._read(table, OFFSETS)))
        total = reduce(DataFrame.unionByName, sizes)
        return total.agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))

    def ledger(self) -> DataFrame:
        return self._all("ledger", LEDGER)

    def handled_by(self, consumer_id: str, index_name: str, ids: DataFrame | None = None) -> DataFrame:
        """The ledger rows of one consumer. With ``ids`` (a column doc_id) at least those of these ids.

        Gathered rows lie in buckets by the hash of their id, each of about ``bucket_rows`` rows however many there are
        in all: a batch of few ids opens as few files of a large ledger as of a small one. Commits that compaction has
        not gathered yet are read whole.
        """
        if ids is None:
            return self._all_mine("ledger", LEDGER, consumer_id, index_name)
        later, merged = self._parts("ledger", LEDGER, consumer_id, index_name)
        if merged is None:
            return later
        upto = self._upto("ledger", consumer_id, index_name)
        buckets = max(self._numbers(f"{self._folder(_merged('ledger'), consumer_id, index_name)}/{_part('upto', upto)}", "buckets"), default=1)
        # As many rows as buckets at most.
        hit = [r.bucket for r in ids.select(_bucket(buckets).alias("bucket")).distinct().collect()]
        # As constants, they choose folders before anything is read.
        found = merged if len(hit) == buckets else merged.filter(F.col("bucket").isin(hit))
        return found.select(*later.columns).unionByName(later)

    def open_attempts(self) -> DataFrame:
        """Reads that were begun and not finished."""
        return self._read("attempts", ATTEMPTS)

    def latest(self) -> DataFrame:
        return ops.latest_offsets(self.log())

    # --- one consumer

    def load(self, consumer_id: str, index_name: str, before: int | None = None) -> Position:
        """The current record, or a fresh one. An unreadable store raises: it is not a fresh start.

        ``before`` looks only at earlier commit numbers, which is what a replayed commit builds on.
        This is the only offset row that reaches the driver. As a constant it can be pushed down.
        """
        self._repair(consumer_id, index_name)
        query_start = self._query_start(consumer_id, index_name)
        folder, upto = self._folder(OFFSET_TABLE, consumer_id, index_name), self._upto(OFFSET_TABLE, consumer_id, index_name)
        numbers = [n for n in self._numbers(folder, "commit_seq") if n > upto and (before is None or n < before)]
        inner = self._inner(OFFSETS, "commit_seq")
        for number in sorted(numbers, reverse=True):
            record = self.spark.read.schema(inner).parquet(f"{folder}/{_part('commit_seq', number)}")
            found = self._position(record.withColumn("commit_seq", F.lit(number)), query_start)
            if found is not None:  # else a commit that never completed
                return found
        if upto >= 0:
            merged = self._all_mine(OFFSET_TABLE, OFFSETS, consumer_id, index_name).filter(F.col("commit_seq") <= upto)
            if before is not None:
                merged = merged.filter(F.col("commit_seq") < before)
            found = self._position(merged.orderBy(F.desc("commit_seq")).limit(1), query_start)
            if found is not None:
                return found
        return Position(0, None, 0, query_start, 0, -1)

    def _position(self, record: DataFrame, query_start) -> Position | None:
        row = record.select(
            micros(F.col("last_processed_timestamp")).alias("us"),
            "last_processed_doc_id",
            "total_processed",
            "epoch",
            "deleted",
            "commit_seq",
            micros(F.col("sought_timestamp")).alias("floor"),
        ).first()
        if row is None:
            return None
        if row.deleted:
            return Position(0, None, 0, query_start, row.epoch, row.commit_seq)
        return Position(row.us, row.last_processed_doc_id, row.total_processed, query_start, row.epoch, row.commit_seq, row.floor)

    # --- commits

    def attempt_path(self, table: str, consumer_id: str, index_name: str, token: str) -> str:
        """Where a commit writes its part of ``table`` before it is published. Readers pass over such folders."""
        return f"{self._folder(table, consumer_id, index_name)}/{ATTEMPT}{token}"

    def _head(self, consumer_id, index_name, after: int) -> str:
        return f"{self._folder('heads', consumer_id, index_name)}/{_part('after', after)}"

    def _finish(self, told: dict) -> None:
        """Bring a published commit to its places. Repeating it, or two processes doing it, changes nothing."""
        for path, to in told["moves"]:
            move_once(self.spark, path, to)
        if told["step"]:
            folder, number = told["step"]
            make(self.spark, f"{folder}/step={number}")
            for older in self._numbers(folder, "step"):
                if older < number:
                    delete(self.spark, f"{folder}/step={older}")

    def _repair(self, consumer_id, index_name) -> None:
        """Finish the newest published commit, should its writer have ended in between."""
        heads = self._numbers(self._folder("heads", consumer_id, index_name), "after")
        if heads:
            told = json.loads(read_text(self.spark, self._head(consumer_id, index_name, max(heads))))
            if any(exists(self.spark, path) for path, _ in told["moves"]) or told["step"] and not self._stepped(*told["step"]):
                self._finish(told)

    def _stepped(self, folder, number) -> bool:
        return any(n >= number for n in self._numbers(folder, "step"))

    def _writer(self, consumer_id, index_name, writer) -> str:
        return f"{self._folder('writers', consumer_id, index_name)}/{writer}"

    def has_step(self, consumer_id: str, index_name: str, writer: str, step: int) -> bool:
        """Whether this step of a writer has been committed."""
        return self.last_step(consumer_id, index_name, writer) >= step

    def last_step(self, consumer_id: str, index_name: str, writer: str) -> int:
        """The newest step that a writer has committed; below all numbers if none."""
        self._repair(consumer_id, index_name)
        return max(self._numbers(self._writer(consumer_id, index_name, writer), "step"), default=-1)

    def publish(
        self, consumer_id, index_name, before: Position, after: Position, token: str | None = None, moves=(), step=None, deleted=False, updated=None,
        record: str | None = None,
    ) -> bool:
        """Make ``after`` the record that follows ``before``, unless another writer was faster; then False.

        All that belongs to the commit has been written aside. What decides is one file, named after the commit it
        follows and created only if it does not exist: of any number of writers that build on one commit, one wins. Its
        content says what to move where (``moves``: pairs of paths), so that any later reader can finish it. The same
        ``token`` wins again. ``step``: (writer, number), noted as done with the commit. ``record``: where
        :meth:`stage_records` has written the record already.
        """
        token, offsets = token or uuid.uuid4().hex, self._folder(OFFSET_TABLE, consumer_id, index_name)
        # Compaction removes the record of a commit before the head that follows it: while the record is there, creating
        # the head tells whether someone has built on it, and not all heads need be listed.
        if record is None or not exists(self.spark, f"{offsets}/{_part('commit_seq', before.commit_seq)}"):
            heads = self._numbers(self._folder("heads", consumer_id, index_name), "after")
            if max(heads, default=-2) >= before.commit_seq:  # someone has built on it already
                return self._holds(consumer_id, index_name, before, token)
        if record is None:
            record = self.attempt_path(OFFSET_TABLE, consumer_id, index_name, token)
            self._record(after, updated, deleted).write.mode("overwrite").parquet(record)
        target = f"{offsets}/{_part('commit_seq', after.commit_seq)}"
        # The record comes last: once it is in its place, so is all the rest.
        told = {
            "token": token,
            "moves": [*map(list, moves), [record, target]],
            "step": step and [self._writer(consumer_id, index_name, step[0]), step[1]],
        }
        if create_with(self.spark, self._head(consumer_id, index_name, before.commit_seq), json.dumps(told)):
            self._finish(told)
            return True
        held = self._holds(consumer_id, index_name, before, token)
        if not held:
            delete(self.spark, record)
        return held

    def _holds(self, consumer_id, index_name, before, token) -> bool:
        path = self._head(consumer_id, index_name, before.commit_seq)
        if not exists(self.spark, path):
            return False
        told = json.loads(read_text(self.spark, path))
        if told["token"] == token:
            self._finish(told)
        return told["token"] == token

    def starting_point(self, consumer_id: str, index_name: str, writer: str) -> Position:
        """The position at which ``writer`` first began, remembered for its restarts."""
        folder = self._writer(consumer_id, index_name, writer)
        numbers = self._numbers(folder, "began_after")
        if not numbers:
            now = self.load(consumer_id, index_name)
            make(self.spark, f"{folder}/began_after={now.commit_seq}")
            return now
        return self.load(consumer_id, index_name, before=min(numbers) + 1)

    def exists(self, consumer_id: str, index_name: str) -> bool:
        mine = self._all_mine(OFFSET_TABLE, OFFSETS, consumer_id, index_name)
        return not ops.latest_offsets(mine).isEmpty()

    def save(self, consumer_id: str, index_name: str, position: Position, updated=None) -> None:
        """Record a position under ``position.commit_seq``, whatever is there; saving it again changes nothing.

        For one writer, and for repairs by hand: writers that may meet use :meth:`publish`.
        """
        row = self._record(position, updated, False)
        self._write(row, OFFSET_TABLE, OFFSETS, consumer_id, index_name, position.commit_seq)

    def _record(self, position, updated, deleted) -> DataFrame:
        columns = {f.name: f.dataType for f in OFFSETS.fields}
        row = self._one_row().select(
            as_bound(position.micros).alias("last_processed_timestamp"),
            F.lit(position.doc_id).cast("string").alias("last_processed_doc_id"),
            (F.current_timestamp() if updated is None else as_bound(updated)).alias("last_updated"),
            F.lit(position.total).alias("total_processed"),
            as_bound(position.query_start).alias("query_start_timestamp"),
            as_bound(position.floor).alias("sought_timestamp"),
            F.lit(position.epoch).alias("epoch"),
            F.lit(deleted).alias("deleted"),
        )
        return row.select(*[F.col(c).cast(columns[c]).alias(c) for c in row.columns])

    def record_handled(self, consumer_id: str, index_name: str, commit_seq: int, events: DataFrame, epoch=0) -> None:
        rows = events.select("doc_id", "timestamp", F.lit(epoch).alias("epoch"))
        self._write(rows, "ledger", LEDGER, consumer_id, index_name, commit_seq)

    def stage_handled(self, consumer_id: str, index_name: str, number: int, events: DataFrame, epoch: int, token: str) -> tuple[str, str]:
        """Write the ledger rows of a commit aside; the pair of paths is for :meth:`publish`."""
        path = self.attempt_path("ledger", consumer_id, index_name, token)
        self._handled(events, epoch).write.mode("overwrite").parquet(path)
        return path, self.handled_path(consumer_id, index_name, number)

    def stage_handled_parts(self, consumer_id: str, index_name: str, events: DataFrame, epoch: int, token: str, part: str) -> str:
        """As :meth:`stage_handled`, of many commits at once: one folder for each value of the column ``part``, under the path
        returned."""
        path = self.attempt_path("ledger", consumer_id, index_name, token)
        self._handled(events, epoch, part).write.mode("overwrite").partitionBy(part).parquet(path)
        return path

    def handled_path(self, consumer_id: str, index_name: str, number: int) -> str:
        """Where the ledger rows of a commit belong."""
        return f"{self._folder('ledger', consumer_id, index_name)}/{_part('commit_seq', number)}"

    def _handled(self, events: DataFrame, epoch: int, *more: str) -> DataFrame:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._inner(LEDGER, "commit_seq").fields]
        return events.select("doc_id", "timestamp", F.lit(epoch).alias("epoch"), *more).select(*columns, *more)

    def stage_records(self, consumer_id: str, index_name: str, positions: list[Position], token: str) -> list[str]:
        """Write the records of commits that are to follow one another aside, in one job; their paths, for :meth:`publish`."""
        path = self.attempt_path(OFFSET_TABLE, consumer_id, index_name, token)
        ddl = "us long, id string, total long, query_start long, epoch long, commit_seq long, floor long"
        rows = self.spark.createDataFrame([tuple(p) for p in positions], ddl)
        record = rows.select(
            F.timestamp_micros("us").alias("last_processed_timestamp"),
            F.col("id").alias("last_processed_doc_id"),
            F.current_timestamp().alias("last_updated"),
            F.col("total").alias("total_processed"),
            F.timestamp_micros("query_start").alias("query_start_timestamp"),
            F.timestamp_micros("floor").alias("sought_timestamp"),
            "epoch",
            F.lit(False).alias("deleted"),
            "commit_seq",
        )
        types = {f.name: f.dataType for f in OFFSETS.fields}
        columns = [F.col(c).cast(types[c]).alias(c) for c in record.columns]
        record.select(*columns).write.mode("overwrite").partitionBy("commit_seq").parquet(path)
        return [f"{path}/{_part('commit_seq', p.commit_seq)}" for p in positions]

    def _move(self, consumer_id: str, index_name: str, change: Callable[[Position], Position], deleted=False) -> Position:
        """Apply ``change`` to the newest record, again and again until no other writer gets in between."""
        while True:
            now = self.load(consumer_id, index_name)
            after = change(now)._replace(query_start=None, commit_seq=now.commit_seq + 1)
            if self.publish(consumer_id, index_name, now, after, deleted=deleted):
                return after

    def _change(self, consumer_id: str, index_name: str, **fields) -> Position:
        return self._move(consumer_id, index_name, lambda now: now._replace(**fields))

    def update(self, consumer_id: str, index_name: str, ts, doc_id: str) -> Position:
        """Set the position to one event; ``ts`` as :func:`as_bound` takes it. The total is kept."""
        us = self._one_row().select(micros(as_bound(ts)).alias("us")).first().us
        return self._change(consumer_id, index_name, micros=us, doc_id=doc_id)

    def update_from_display(self, consumer_id: str, index_name: str, text: str, doc_id: str, zone: str = "UTC") -> Position:
        """As :meth:`update`, from a display text on the clock of ``zone`` (ISO text is taken as well)."""
        us = self._one_row().select(micros(to_instant(F.lit(text), zone)).alias("us")).first().us
        return self._change(consumer_id, index_name, micros=us, doc_id=doc_id)

    def increment(self, consumer_id: str, index_name: str, by: int = 1) -> Position:
        """Add to the number of events handled; the position stays."""
        return self._move(consumer_id, index_name, lambda now: now._replace(total=now.total + by))

    def start_display(self, consumer_id: str, index_name: str, zone: str = "UTC") -> str:
        """Display text of the effective start: where an unfinished read began, else the last position."""
        at = self.load(consumer_id, index_name)
        us = at.micros if at.query_start is None else at.query_start
        return self._one_row().select(display_text(as_bound(us), zone).alias("text")).first().text

    def seconds_since_commit(self, consumer_id: str, index_name: str) -> float | None:
        """Since the newest record was written; None before the first."""
        mine = self._all_mine(OFFSET_TABLE, OFFSETS, consumer_id, index_name)
        age = (micros(F.current_timestamp()) - micros(F.max("last_updated"))) / 1e6
        return mine.agg(age.alias("age")).first().age

    def delete_offset(self, consumer_id: str, index_name: str) -> None:
        """A tombstone; the history stays. The epoch rises, so handled events are due again."""
        if self.load(consumer_id, index_name).commit_seq >= 0:
            self._move(consumer_id, index_name, lambda now: Position(0, None, 0, None, now.epoch + 1, now.commit_seq), deleted=True)

    def seek(self, consumer_id: str, index_name: str, to) -> Position:
        """Move to a time (micros, datetime or ISO text). The total is kept, the epoch is raised."""
        us = self._one_row().select(micros(as_bound(to)).alias("us")).first().us
        return self._move(consumer_id, index_name, lambda now: Position(us, None, now.total, None, now.epoch + 1, now.commit_seq, us))

    def reset(self, consumer_id: str, index_name: str) -> Position:
        return self.seek(consumer_id, index_name, 0)

    def status(self, consumer_id: str, index_name: str, session_start: int = 0) -> DataFrame:
        """Id, index, events handled since commit ``session_start`` and ever, and the position, as one row."""
        at = self.load(consumer_id, index_name)
        session = self.handled_by(consumer_id, index_name).filter(F.col("commit_seq") >= session_start)
        return session.agg(F.count(F.lit(1)).alias("session_processed")).select(
            F.lit(consumer_id).alias("consumer_id"),
            F.lit(index_name).alias("index_name"),
            "session_processed",
            F.lit(at.total).alias("total_processed"),
            as_bound(at.micros).alias("last_timestamp"),
            F.lit(at.doc_id).cast("string").alias("last_doc_id"),
        )

    def compact(self, consumer_id: str, index_name: str) -> None:
        """Gather the offset records and ledger rows of committed commits in one directory each.

        Every row stays, with its commit number, so totals, sessions and replays are as before. The gathered
        rows are written before the directories they replace are removed, and count from the moment they are
        complete; a crash in between changes nothing. Empty directories of commits that never completed and
        lie above the newest complete one are not touched.
        """
        committed = self.load(consumer_id, index_name).commit_seq
        for table, schema in ((OFFSET_TABLE, OFFSETS), ("ledger", LEDGER)):
            folder, merged = (self._folder(t, consumer_id, index_name) for t in (table, _merged(table)))
            upto = self._upto(table, consumer_id, index_name)
            old = [n for n in self._numbers(folder, "commit_seq") if n <= committed]
            if len([n for n in old if n > upto]) > 1:
                rows = self._all_mine(table, schema, consumer_id, index_name).filter(F.col("commit_seq") <= committed)
                columns = [f.name for f in schema.fields if f.name not in ("consumer_id", "index_name")]
                aside = f"{merged}/_{committed}"
                # Buckets double as the ledger grows; the offset log, a row a commit, has one.
                files = 1 << max(0, math.ceil(math.log2(max(1, rows.count()) / self.bucket_rows)))
                bucket = _bucket(files) if table == "ledger" else F.lit(0).cast("long")
                placed = rows.select(*columns, F.lit(files if table == "ledger" else 1).cast("long").alias("buckets"), bucket.alias("bucket"))
                order = ["bucket", *(["doc_id"] if table == "ledger" else ["commit_seq"])]
                laid = placed.repartition(files, "bucket").sortWithinPartitions(*order)
                laid.write.mode("overwrite").partitionBy("buckets", "bucket").parquet(aside)
                rename(self.spark, aside, f"{merged}/{_part('upto', committed)}")
                if upto >= 0:
                    delete(self.spark, f"{merged}/{_part('upto', upto)}")
                upto = committed
            for number in old:
                if number <= upto:
                    delete(self.spark, f"{folder}/{_part('commit_seq', number)}")
            drop_stale(self.spark, folder, ATTEMPT, STALE_SECONDS)
        # A writer that still builds on an old commit must go on finding its successor.
        for number in sorted(self._numbers(self._folder("heads", consumer_id, index_name), "after"))[:-KEPT_HEADS]:
            delete(self.spark, self._head(consumer_id, index_name, number))

    # --- read attempts

    def _marks(self, consumer_id, index_name) -> str:
        return self._folder("marks", consumer_id, index_name)

    def mark_start(self, consumer_id: str, index_name: str, at=None) -> int:
        """Note that a read begins; earlier unfinished reads keep their own mark, also those of other processes."""
        now = F.timestamp_micros(F.lit(time.time_ns() // 1000)) if at is None else as_bound(at)
        us = self._one_row().select(micros(now).alias("us")).first().us
        folder, marks = self._folder("attempts", consumer_id, index_name), self._marks(consumer_id, index_name)
        attempt = max([*self._numbers(folder, "attempt"), *self._numbers(marks, "attempt")], default=-1) + 1
        while not create_with(self.spark, f"{marks}/{_part('attempt', attempt)}", str(us)):
            attempt += 1
        # Written aside, so that no reader lists half a mark.
        aside = f"{folder}/{ATTEMPT}{uuid.uuid4().hex}"
        self._one_row().select(as_bound(us).alias("at")).write.mode("overwrite").parquet(aside)
        move_once(self.spark, aside, f"{folder}/{_part('attempt', attempt)}")
        return attempt

    def clear_start(self, consumer_id: str, index_name: str, attempt: int | None = None) -> None:
        """The read and its whole batch are finished: remove its mark, and those of failed reads before it.

        Marks after ``attempt`` belong to reads still in flight and stay; without it all go.
        """
        for folder in (self._folder("attempts", consumer_id, index_name), self._marks(consumer_id, index_name)):
            for number in self._numbers(folder, "attempt"):
                if attempt is None or number <= attempt:
                    delete(self.spark, f"{folder}/{_part('attempt', number)}")

    def _query_start(self, consumer_id, index_name) -> int | None:
        """When the oldest open read began."""
        folder, began = self._marks(consumer_id, index_name), []
        for number in self._numbers(folder, "attempt"):
            try:
                began.append(int(read_text(self.spark, f"{folder}/{_part('attempt', number)}")))
            except Py4JJavaError:
                if exists(self.spark, f"{folder}/{_part('attempt', number)}"):
                    raise  # else its reader has just finished
        return min(began, default=None)

    def start_columns(self) -> DataFrame:
        """Per live consumer: the plain effective start and the one a reader may safely use."""
        started = self.open_attempts().groupBy("consumer_id", "index_name").agg(F.min("at").alias("query_start"))
        last = F.col("last_processed_timestamp")
        return (
            self.latest()
            .join(started, ["consumer_id", "index_name"], "left")
            .select(
                "consumer_id",
                "index_name",
                effective_start(F.col("query_start"), last).alias("effective_start"),
                safe_start(F.col("query_start"), last).alias("safe_start"),
            )
        )


def append_commits(log: DataFrame, path: str, batch: int) -> None:
    """Append many commit rows as one batch directory; writing the batch again replaces it."""
    prepare(log.sparkSession)
    log.write.mode("overwrite").parquet(f"{path}/batch={batch}")

