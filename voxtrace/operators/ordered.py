"""Ordered computations that never put one key, however hot, into one task.

``Window.partitionBy(key)`` sends a whole key to one task. The functions here range-partition
on (keys, order) instead, so a hot key is spread over many tasks, do the ordered work inside
each slice, and correct it with one small row per (key, slice).

Keys and order columns must not be null, and the order must be unique within a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtrace.session import stage

SLICE = "_slice"


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition on (keys, order) and keep the slice number as a column."""
    cols = [F.col(f"`{c}`") for c in (*keys, *order)]
    return stage(
        df.repartitionByRange(*cols).withColumn(SLICE, F.spark_partition_id()), "slices"
    )


def _slice_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` within ``keys`` in ``order``."""
    sliced = range_slices(df.withColumn("_w", weight), keys, order)
    inside = F.sum("_w").over(
        _slice_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    per_slice = sliced.groupBy(*keys, SLICE).agg(F.sum("_w").alias("_slice_sum"))
    across = Window.partitionBy(*keys).orderBy(SLICE)
    before = F.coalesce(
        F.sum("_slice_sum").over(across.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0).cast("bigint"),
    )
    offsets = per_slice.withColumn("_before", before)
    if total is not None:
        offsets = offsets.withColumn(total, F.sum("_slice_sum").over(Window.partitionBy(*keys)))
    return (
        sliced.withColumn("_inside", inside)
        .join(offsets.drop("_slice_sum"), [*keys, SLICE])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_w", "_inside", "_before", SLICE)
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn"
) -> DataFrame:
    """``row_number()`` per key in ``order``, starting at 1."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out)


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str
) -> DataFrame:
    """Value of ``column`` (not null) on the following row of the same key, else null."""
    sliced = range_slices(df, keys, order)
    inside = F.lead(column).over(_slice_window(keys, order))
    heads = sliced.groupBy(*keys, SLICE).agg(
        F.min_by(column, F.struct(*order)).alias("_head")
    )
    following = heads.withColumn(
        "_next_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy(SLICE))
    ).drop("_head")
    return (
        sliced.withColumn("_inside", inside)
        .join(following, [*keys, SLICE])
        .withColumn(out, F.coalesce("_inside", "_next_head"))
        .drop("_inside", "_next_head", SLICE)
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str
) -> DataFrame:
    """Latest non-null value of ``column`` at or before each row of the same key."""
    sliced = range_slices(df, keys, order)
    inside = F.last(column, ignorenulls=True).over(
        _slice_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    tails = sliced.groupBy(*keys, SLICE).agg(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_tail")
    )
    earlier = tails.withColumn(
        "_carried",
        F.last("_tail", ignorenulls=True).over(
            Window.partitionBy(*keys)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        ),
    ).drop("_tail")
    return (
        sliced.withColumn("_inside", inside)
        .join(earlier, [*keys, SLICE])
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried", SLICE)
    )


def dealt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows hash-partitioned by ``columns``, in as many tasks as the session shuffles to.

    For groups of few rows each: a table of groups on the map side would hold nearly every row of
    a file split, and merge hardly any. An explicit number keeps adaptive execution from folding
    partitions into few tasks by their compressed size.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *[F.col(f"`{c}`") for c in columns])


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join many rows to at most one ``right`` row per key when some keys are hot.

    Each left row goes to one of ``salts`` copies of its key, chosen by a hash of the
    ``spread`` columns; the right side, one row per key, is copied ``salts`` times. Both sides are
    shuffled whatever their estimated size: the planner does not know of the copies, and would
    send a small file's rows ``salts`` times through the driver.
    """
    salted_left = left.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(salts)).cast("int")
    )
    salted_right = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted_left.join(salted_right.hint("merge"), [*on, "_salt"], how).drop("_salt")
