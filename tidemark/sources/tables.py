"""Declared parquet tables: created only if absent, written by id."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.upsert import newest_per_id, upsert
from tidemark.plans.workspace import prepare, settle
from tidemark.schemas import EVENTS, same_columns
from tidemark.sources.files import child_names, create_with, delete, exists, move_once, read_text

# Events are laid out by day, so a time bound prunes directories.
DAY = "event_date"
# Fixed value: Spark's name for the partition of rows without one.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
# Beside the days, in folders that Spark's readers pass over: what upserts did, and which days an id is in.
LOG, KEYS = "_log", "_keys"
# Fixed value: how often an upsert starts again because others were faster.
UPSERT_TRIES = 10


def to_declared(df: DataFrame, schema=EVENTS) -> DataFrame:
    """The declared columns, in order and cast to the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def create_if_absent(spark: SparkSession, path: str, schema=EVENTS) -> bool:
    """Create an empty table; True if it was created. An existing one must have the same columns."""
    if exists(spark, path):
        present = spark.read.parquet(path).drop(DAY).schema
        if not same_columns(present, schema):
            raise ValueError(f"table at {path} has columns {present.simpleString()}, not {schema.simpleString()}")
        return False
    prepare(spark).createDataFrame([], schema).write.parquet(path)
    return True


def by_day(df: DataFrame, ts="timestamp") -> DataFrame:
    return df.withColumn(DAY, F.to_date(ts))


def write_by_day(df: DataFrame, path: str) -> None:
    """Write whole days, replacing those present. Large days are split over tasks, small ones merged."""
    prepare(df.sparkSession)
    dated = df if DAY in df.columns else by_day(df)
    (
        dated.hint("rebalance", DAY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )


def load_events(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Write events by id, each id once, creating the table with the first load."""
    if exists(spark, path):
        upsert_into(spark, path, incoming)
    else:
        fresh = settle(by_day(newest_per_id(incoming)), "loaded")
        _note_days(fresh, path, 0, "doc_id")
        write_by_day(fresh, path)


class UpsertConflict(RuntimeError):
    """Other upserts into the table were faster, again and again."""


def _log_numbers(spark, path) -> list[int]:
    return [int(n.split("=")[1]) for n in child_names(spark, f"{path}/{LOG}") if n.startswith("upsert=")]


def _note_days(rows: DataFrame, path: str, number: int, key: str) -> None:
    """Add the day of every row to the key index: pairs of (hash of the id, day), ordered by hash."""
    pairs = rows.select(F.xxhash64(key).alias("h"), F.col(DAY).alias("day")).distinct()
    pairs.repartitionByRange("h").sortWithinPartitions("h").write.mode("overwrite").parquet(f"{path}/{KEYS}/{number}-{uuid.uuid4().hex}")


def key_days(spark: SparkSession, path: str, key="doc_id") -> DataFrame:
    """(h, day) of the key index. It may name a day that an id has left, never lacks one that it is in. A table without an
    index gets one from a single pass over its ids."""
    if not child_names(spark, f"{path}/{KEYS}"):
        _note_days(spark.read.schema(f"{key} string, {DAY} date").parquet(path), path, 0, key)
    # Pairs of the first loads and of later ones lie in folders of their own.
    return spark.read.schema("h long, day date").option("recursiveFileLookup", True).parquet(f"{path}/{KEYS}")


def recover(spark: SparkSession, path: str) -> None:
    """Finish the newest upsert, should its writer have ended in between. Every reader of this library calls it."""
    numbers = _log_numbers(spark, path)
    if numbers:
        told = json.loads(read_text(spark, f"{path}/{LOG}/upsert={max(numbers)}"))
        if exists(spark, told["staged"]):
            _apply(spark, told)


def _apply(spark, told) -> None:
    for folder, to in told["moves"]:
        move_once(spark, folder, to)
    for folder in told["gone"]:
        delete(spark, folder)
    delete(spark, told["staged"])  # last: as long as it is there, the upsert is not finished


def upsert_into(spark: SparkSession, path: str, incoming: DataFrame, version=None, key="doc_id") -> list:
    """Upsert into a table written by :func:`write_by_day`; returns the days read and rewritten.

    Of several rows of one id in ``incoming`` the newest is written (see :func:`newest_per_id`). Only the days that hold
    one of the ids (by the key index) or get one are opened. Their new content is written aside; one file, which only one
    writer can create, then says what to move where, and whoever comes next finishes it: a writer that ends in between
    leaves no id twice. An upsert that another one overtook starts again.
    """
    incoming = newest_per_id(incoming, version, key)
    incoming = settle(by_day(incoming.drop(version) if version else incoming), "incoming")
    for _ in range(UPSERT_TRIES):
        recover(spark, path)
        number = max(_log_numbers(spark, path), default=0) + 1
        keys = incoming.select(F.xxhash64(key).alias("h"))
        hit = key_days(spark, path, key).join(keys, "h", "left_semi").select(F.col("day").alias(DAY))
        # One row per day: as many as the calendar has, not as many as there are events.
        days = [r[DAY] for r in hit.union(incoming.select(DAY)).distinct().collect()]
        folder = lambda day: f"{DAY}={NO_DAY if day is None else day}"
        present = [f"{path}/{folder(day)}" for day in days if exists(spark, f"{path}/{folder(day)}")]
        reader = spark.read.schema(incoming.schema).option("basePath", path)
        affected = reader.parquet(*present) if present else incoming.limit(0)
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        write_by_day(upsert(affected, incoming, key), staged)
        # First the index, which may say too much but not too little.
        _note_days(incoming, path, number, key)
        made = [n for n in child_names(spark, staged) if n.startswith(f"{DAY}=")]
        told = {
            "staged": staged,
            "moves": [[f"{staged}/{n}", f"{path}/{n}"] for n in made],
            "gone": [f"{path}/{folder(day)}" for day in days if folder(day) not in made],
        }
        if create_with(spark, f"{path}/{LOG}/upsert={number}", json.dumps(told)):
            _apply(spark, told)
            return days
        delete(spark, staged)
    raise UpsertConflict(f"upserts into {path} were overtaken {UPSERT_TRIES} times")
