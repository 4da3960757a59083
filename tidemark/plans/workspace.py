"""Written intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import delete


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def prepare(spark: SparkSession) -> SparkSession:
    """Write times as 64-bit microseconds: the older 96-bit form keeps no usable statistics, so a
    time bound could not skip row groups."""
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    return spark


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def discard_scratch(spark: SparkSession) -> None:
    """Delete what this application has settled. Call it when its results have been written."""
    delete(spark, _scratch(spark))


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """A write within drops its shuffle files when it ends; otherwise they stay until the driver happens to collect
    its garbage. Only for plans that run once: another run of the same plan would make them anew."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage, survives lost executors, pins values that would differ between two evaluations
    (partition ids, say), and gives the planner the true size of what follows.
    """
    path = fresh_path(prepare(df.sparkSession), label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
