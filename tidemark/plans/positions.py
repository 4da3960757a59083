"""Running numbers and running maxima per key without gathering a key in one task.

Rows are range-partitioned on (key, order), so a hot key spreads over as many partitions as its
share needs. Each partition is numbered locally, one summary row per (key, partition) is carried
forward, and the two are added. The laid-out rows are written once: partition numbers must not be
evaluated twice.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.joins import null_safe
from tidemark.plans.workspace import settle

# monotonically_increasing_id() holds the partition number above bit 33, the row number below.
_PARTITION_BITS = 33


def _lay_out(df: DataFrame, keys, order) -> DataFrame:
    laid = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return settle(laid, "ordered").withColumn("_part", F.shiftright("_slot", _PARTITION_BITS))


def _join_parts(laid: DataFrame, parts: DataFrame, keys) -> DataFrame:
    # One row per (key, partition). The written size decides between broadcast and a shuffle on
    # (key, partition), which is even because range partitions are.
    return null_safe(laid, settle(parts, "parts"), [*keys, "_part"])


def with_position(df: DataFrame, keys, order, name="rn", total=None) -> DataFrame:
    """Number the rows 1, 2, ... within each key. ``order`` should tell rows of one key apart.

    ``total`` names a further column for the number of rows of the key.
    """
    keys = list(keys)
    laid = _lay_out(df, keys, order)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        laid.groupBy(*keys, "_part")
        .agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    if total:
        parts = parts.withColumn(total, F.sum("_n").over(W.partitionBy(*keys)))
    parts = parts.drop("_n")
    numbered = _join_parts(laid, parts, keys)
    return numbered.withColumn(name, F.col("_before") + F.col("_slot") - F.col("_first") + 1).drop(
        "_slot", "_part", "_first", "_before"
    )


def with_running_max(df: DataFrame, keys, order, value, name="high") -> DataFrame:
    """The largest ``value`` among the rows *before* each row of its key (null for the first)."""
    keys = list(keys)
    laid = _lay_out(df, keys, order)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        laid.groupBy(*keys, "_part")
        .agg(F.max(value).alias("_top"))
        .withColumn("_carried", F.max("_top").over(earlier))
        .drop("_top")
    )
    within = W.partitionBy(*keys, "_part").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    local = _join_parts(laid, parts, keys).withColumn("_local", F.max(value).over(within))
    return local.withColumn(name, F.greatest("_carried", "_local")).drop("_slot", "_part", "_carried", "_local")


def events_up_to(events: DataFrame, marks: DataFrame, keys, order, mark_id, name="before") -> DataFrame:
    """For each mark, how many events of its key lie at or before it.

    Both sides are laid out in one order, so the cost is one sort however many marks there are.
    ``marks`` has the key, the order columns (null = before everything), ``_tail`` (1 puts the mark
    after all events of the same first order column) and ``mark_id``.
    """
    keys, order = list(keys), list(order)
    as_event = events.select(
        *keys,
        *order,
        F.lit(0).alias("_tail"),
        F.lit(0).alias("_kind"),
        *[F.lit(None).cast(marks.schema[m].dataType).alias(m) for m in mark_id],
    )
    as_mark = marks.select(*keys, *order, "_tail", F.lit(1).alias("_kind"), *mark_id)
    sequence = [order[0], "_tail", *order[1:], "_kind", *mark_id]
    together = with_position(as_event.unionByName(as_mark), keys, sequence, "_all")
    among_marks = with_position(as_mark, keys, sequence, "_marks").select(*keys, *mark_id, "_marks")
    return (
        together.filter("_kind = 1")
        .join(among_marks, [*keys, *mark_id])
        .select(*keys, *mark_id, (F.col("_all") - F.col("_marks")).alias(name))
    )



