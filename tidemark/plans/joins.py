"""Joining many rows to one row per key, where a key may hold a large share of the rows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.workspace import settle

# Above this many rows the per-key side is no longer broadcast.
BROADCAST_ROWS = 10_000
# Beyond that, a key is split into one part for about this many rows of the whole table, at least LEAST_SALTS.
ROWS_PER_SALT = 20_000_000
LEAST_SALTS = 64


def null_safe(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Join on ``keys``, a null key meeting a null key. The keys appear once, as after a join by name."""
    keys = list(keys)
    other = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(other, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    key = [F.coalesce(k, f"_right_{k}").alias(k) if how == "full" else F.col(k) for k in keys]
    rest = [c for c in (*left.columns, *right.columns) if c not in keys]
    return joined.select(*key, *rest)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``rows + 1`` rows to decide."""
    return df.limit(rows + 1).count() <= rows


def attach_per_key(
    rows: DataFrame, per_key: DataFrame, keys, spread_on, how="left", broadcast_rows=BROADCAST_ROWS, counted=None
):
    """Join ``rows`` to ``per_key``, which has at most one row per key.

    A checked-small ``per_key`` is broadcast, so ``rows`` are not shuffled. Otherwise each key is
    split by ``spread_on`` into parts that grow in number with the rows, so that a hot key does not land in one
    task. Null keys meet null keys.
    ``counted`` is the number of rows of a ``per_key`` that is already settled.
    """
    keys = list(keys)
    if counted is None:
        per_key = settle(per_key, "per-key")
        small = fits_broadcast(per_key, broadcast_rows)
    else:
        small = counted <= broadcast_rows
    if small:
        return null_safe(rows, F.broadcast(per_key), keys, how)
    salts = max(LEAST_SALTS, rows.count() // ROWS_PER_SALT)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return null_safe(salted, copies, keys + ["_salt"], how).drop("_salt")
