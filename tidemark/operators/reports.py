"""Status, lag and statistics. Every report is a DataFrame; times are arguments, so it repeats."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_bound, epoch, micros
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
from tidemark.operators.offsets import latest_offsets
from tidemark.plans.joins import attach_per_key
from tidemark.plans.positions import events_up_to, with_running_max
from tidemark.plans.workspace import settle
from tidemark.schemas import CONSUMER_KEY, EVENT_ORDER


# Size of a sketch of commit gaps, and the error in rank that this size keeps.
GAP_K = 800
GAP_RANK_ERROR = 0.01


def session_totals(ledger: DataFrame, session_start, keys=("consumer_id",), seq="commit_seq") -> DataFrame:
    """Events handled since the session began, and ever."""
    return ledger.groupBy(*keys).agg(
        F.count_if(F.col(seq) >= F.lit(session_start)).alias("session_n"), F.count(F.lit(1)).alias("total_n")
    )


def consumer_status(log: DataFrame, ledger: DataFrame, session_start, keys=CONSUMER_KEY) -> DataFrame:
    """The live offset record of each consumer with what it handled in this session."""
    session = session_totals(ledger, session_start, keys).select(*keys, "session_n")
    return (
        latest_offsets(log, keys)
        .join(session, list(keys), "left")
        .withColumn("session_n", F.coalesce("session_n", F.lit(0).cast("long")))
    )


def commit_backlog(log: DataFrame, ledger: DataFrame, as_of, last_ts="last_ts", keys=CONSUMER_KEY, spread_on=("doc_id",)):
    """Per consumer: events handled after its last commit, and milliseconds since that commit."""
    newest = latest_offsets(log, keys).select(*keys, F.col("commit_seq").alias("_committed"), F.col(last_ts).alias("_at"))
    newest = settle(newest, "newest")
    since = (
        attach_per_key(
            ledger.select(*keys, "commit_seq", *spread_on),
            newest.drop("_at"),
            keys,
            spread_on,
            "inner",
            counted=newest.count(),
        )
        .filter(F.col("commit_seq") > F.col("_committed"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("uncommitted"))
    )
    now = F.unix_millis(as_bound(as_of))
    return newest.join(since, list(keys), "left").select(
        *keys,
        F.coalesce("uncommitted", F.lit(0).cast("long")).alias("uncommitted"),
        (now - F.unix_millis(F.col("_at").cast("timestamp"))).alias("ms_since"),
    )


def offset_lag(events: DataFrame, offsets: DataFrame, order=EVENT_ORDER, index="index_name", max_marks=None) -> DataFrame:
    """Per consumer: how many events of its index lie after its position, and how far behind it is.

    ``offsets``: consumer_id, ``index``, last_ts, last_id (null last_ts = from the beginning).
    """
    offsets = settle(with_bucket(offsets.select("consumer_id", index, "last_ts", "last_id")), "offsets")
    positions = look_at(offsets, [index, "bucket"])
    ahead = since(events.select(index, *order), positions.earliest, order)
    counts = bucket_counts(ahead, order, index)
    newest = counts.groupBy(index).agg(F.sum("n").alias("_all"), F.max("newest").alias("newest"))
    stands = milestones(counts, offsets, index).filter("is_mark").select(index, "bucket", "n", "up_to")
    # whole hours after the position come from the counts, the hour it stands in is looked into
    hours = settle(stands, "stands")
    inside = in_hours(ahead, hours.filter("n > 0").select(index, "bucket"), order, index)
    placed = offsets.filter(F.col("last_ts").isNotNull())
    count_inside = _inside_by_slot if positions.bounded(max_marks) else _inside_by_rank
    rest = settle(count_inside(inside, placed, order, index), "inside")
    start = F.coalesce(F.col("last_ts"), epoch(offsets.schema["last_ts"].dataType))
    behind = F.floor((micros(F.col("newest")) - micros(start)) / F.lit(1_000_000))
    later = F.coalesce(F.col("_all"), F.lit(0)) - F.coalesce(F.col("up_to"), F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return (
        offsets.join(hours.select(index, "bucket", "up_to"), [index, "bucket"], "left")
        .join(rest, ["consumer_id", index], "left")
        .join(newest, index, "left")
        .select(
            "consumer_id",
            index,
            later.cast("long").alias("lag_n"),
            F.greatest(F.coalesce(behind, F.lit(0)), F.lit(0)).cast("long").alias("lag_s"),
        )
    )


def _inside_by_slot(events, offsets, order, index):
    """Per consumer, the events of its hour after it: counted between neighbouring positions, then added up."""
    group = [index, "bucket"]
    marks = F.broadcast(marks_by(offsets, group))
    slots = events.join(marks, group).groupBy(*group, slot_of_event(order).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    wanted = offsets.join(marks, group).select("consumer_id", *group, slot_of_mark().alias("from_slot"))
    mine = slots.join(F.broadcast(wanted), group).filter(F.col("slot") >= F.col("from_slot"))
    return mine.groupBy("consumer_id", index).agg(F.sum("n").alias("_inside"))


def _inside_by_rank(events, offsets, order, index):
    group = [index, "bucket"]
    events = settle(events, "inside")
    before = events_up_to(events, as_rank_marks(offsets, group, order), group, order, ["consumer_id"])
    totals = events.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return before.join(settle(totals, "totals"), group).select(
        "consumer_id", index, (F.col("_n") - F.col("before")).alias("_inside")
    )


def commit_frequency(log: DataFrame, at="last_updated", keys=CONSUMER_KEY, seq="commit_seq") -> DataFrame:
    """Commits per key and the mean time between them.

    The gaps between consecutive commits add up to last minus first, so no window is needed.
    """
    stamp = micros(F.col(at))
    span = F.max_by(stamp, F.col(seq)) - F.min_by(stamp, F.col(seq))
    n = F.count(F.lit(1))
    return log.groupBy(*keys).agg(
        n.alias("commits"), F.when(n > 1, span / (n - 1) / F.lit(1_000_000.0)).alias("avg_gap_s")
    )


def commit_gaps(log: DataFrame, at="last_updated", keys=CONSUMER_KEY, seq="commit_seq") -> DataFrame:
    """(keys, gap_us): for every commit but a key's first, the time since the one before it, in order of time.

    Running maxima over ranges, so a consumer with very many commits is no single task. Commits without a time are left out.
    """
    rows = log.select(*keys, micros(F.col(at)).alias("_us"), seq).filter("_us IS NOT NULL")
    before = with_running_max(rows, keys, ["_us", seq], "_us", "_before").filter("_before IS NOT NULL")
    return before.select(*keys, (F.col("_us") - F.col("_before")).alias("gap_us"))


def gap_sketches(log: DataFrame, at="last_updated", keys=CONSUMER_KEY, seq="commit_seq", k: int = GAP_K) -> DataFrame:
    """(keys, gaps, longest_us, sketch): per key a quantile sketch of its commit gaps, a few kilobytes however many there are.

    Sketches of parts of a log merge (:func:`merged_gap_sketches`), so what has been sketched need not be read again. A part
    that begins with the last commit of the part before it holds the gap between them, and no gap is counted twice.
    """
    gaps = commit_gaps(log, at, keys, seq).groupBy(*keys)
    return gaps.agg(
        F.count(F.lit(1)).alias("gaps"), F.max("gap_us").alias("longest_us"), F.kll_sketch_agg_bigint("gap_us", F.lit(k)).alias("sketch")
    )


def merged_gap_sketches(parts: DataFrame, keys=CONSUMER_KEY) -> DataFrame:
    """One sketch a key of the rows of any number of :func:`gap_sketches`."""
    return parts.groupBy(*keys).agg(
        F.sum("gaps").alias("gaps"), F.max("longest_us").alias("longest_us"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )


def gap_quantile(share: float, sketch="sketch"):
    """The gap (microseconds) that ``share`` of the gaps do not exceed; off by less than GAP_RANK_ERROR of all gaps in rank."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(share)))


def table_stats(table: DataFrame) -> DataFrame:
    """Rows and stored bytes of a file-backed table."""
    files = table.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size")
    )
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
