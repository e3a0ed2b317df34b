"""Exact positions over whole tables without numbering them in one task.

A position is the number of rows in lower buckets plus the place inside the own bucket. Only the
bucket sizes, whose number is fixed beforehand, meet in one task. In the seeded random order a bucket is
a prefix of the hash sorted by; in key order it is a range partition. Keys must be unique for positions
to be reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import fixed
from tabloom.session import materialize

# Inside monotonically increasing ids the partition stands above this many bits of row number.
ROW_BITS = 33


def _with_starts(
    placed: DataFrame, inside: Column, within: Sequence[str] = (), out: str = "position", total: str | None = None
) -> DataFrame:
    """Turn ``_bucket`` and the zero-based place ``inside`` it into a position.

    ``_bucket`` takes a number of values fixed by its definition, so its sizes are small enough to
    sum up in one task and to broadcast.
    """
    sizes = placed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    groups = [F.col(c) for c in within]
    below = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *within, "_bucket", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"),
        *([F.sum("_n").over(Window.partitionBy(*groups)).alias(total)] if total else []),
    )
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(starts), [*within, "_bucket"])
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_start", "_inside")
    )


def shuffle_hash(key: Sequence[str], seed: int, epoch: Column | int) -> Column:
    """The reproducible random sort key of a row in an epoch, as 32 hex digits."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), *[F.col(k).cast("string") for k in key]))


def shuffled_position(
    df: DataFrame, key: Sequence[str], seed: int = fixed.SEED, epoch: str | int = 0, digits: int = 3,
    out: str = "position", total: str | None = None,
) -> DataFrame:
    """Zero-based position in the seeded random order, per epoch when ``epoch`` names a column.

    The leading ``digits`` of the hash are the bucket: ``16 ** digits`` evenly filled buckets. ``total``
    names an optional column for the row count of the epoch.
    """
    within = [epoch] if isinstance(epoch, str) else []
    epoch_value = F.col(epoch) if isinstance(epoch, str) else epoch
    hashed = df.withColumn("_hash", shuffle_hash(key, seed, epoch_value)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    inside = Window.partitionBy(*within, "_bucket").orderBy("_hash", *key)
    return _with_starts(hashed, F.row_number().over(inside) - 1, within, out, total).drop("_hash")


def key_position(
    df: DataFrame, order: Sequence[str], out: str = "position", partitions: int | None = None, total: str | None = None
) -> DataFrame:
    """Zero-based position along ascending ``order`` columns.

    The rows are range-partitioned, sorted inside their partitions and stored with partition and row
    number, so they are shuffled once and every later pass sees the same numbers. Pass the columns to
    carry only.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "positions")
    placed = stored.withColumn("_bucket", F.shiftright("_place", ROW_BITS))
    inside = F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    return _with_starts(placed, inside, out=out, total=total).drop("_place")
