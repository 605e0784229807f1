"""Binary morphology on runs of foreground voxels.

A mask line is a set of runs [x0, x1]. A structuring element is a set of rows (dz, dy, lo, hi):
for a given plane and line offset it covers x offsets lo..hi. Dilation moves and widens every
run by every row of the element, erosion moves and narrows it; both then count, along each
target line, how many of the moved runs cover a place. Work per task is bounded by one line
times the rows of the element, however large the volume is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtrace.session import stage

Row = tuple[int, int, int, int]
LINE = ["volume_id", "z", "y"]


def ball(radius: int) -> list[Row]:
    rows = []
    for dz in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            rest = radius * radius - dz * dz - dy * dy
            if rest >= 0:
                half = math.isqrt(rest)
                rows.append((dz, dy, -half, half))
    return rows


def disk(radius: int) -> list[Row]:
    return [row for row in ball(radius) if row[0] == 0]


def square(width: int) -> list[Row]:
    """Square of an odd or even width; an even one reaches one place further back."""
    low, high = -(width // 2), width - 1 - width // 2
    return [(0, dy, low, high) for dy in range(low, high + 1)]


def to_runs(mask: DataFrame) -> DataFrame:
    """(volume_id, z, y, x0, x1) from foreground voxels."""
    line = Window.partitionBy(*LINE).orderBy("x")
    return (
        mask.select(*LINE, "x")
        .withColumn("_island", F.col("x") - F.row_number().over(line))
        .groupBy(*LINE, "_island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_island")
    )


def to_voxels(runs: DataFrame) -> DataFrame:
    return runs.select(*LINE, F.explode(F.sequence("x0", "x1")).alias("x"))


def _covered(moved: DataFrame, least: int) -> DataFrame:
    """Runs of places covered by at least ``least`` of the moved runs."""
    edges = (
        moved.select(
            *LINE,
            F.inline(
                F.array(
                    F.struct(F.col("x0").alias("at"), F.lit(1).alias("step")),
                    F.struct((F.col("x1") + 1).alias("at"), F.lit(-1).alias("step")),
                )
            ),
        )
        .groupBy(*LINE, "at")
        .agg(F.sum("step").alias("step"))
        .where("step <> 0")
    )
    line = Window.partitionBy(*LINE).orderBy("at")
    depth = F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = edges.withColumn("_in", depth >= least)
    # Keep the places where coverage starts or ends; they alternate along the line.
    switches = inside.withColumn("_was", F.coalesce(F.lag("_in").over(line), F.lit(False))).where(
        F.col("_in") != F.col("_was")
    )
    return (
        switches.withColumn("x1", F.lead("at").over(line) - 1)
        .where("_in")
        .select(*LINE, F.col("at").alias("x0"), "x1")
    )


def _move(runs: DataFrame, element: Sequence[Row]) -> DataFrame:
    """Every run once per row of the element."""
    rows = ", ".join(
        f"named_struct('dz', {dz}L, 'dy', {dy}L, 'lo', {lo}L, 'hi', {hi}L)"
        for dz, dy, lo, hi in element
    )
    return runs.select("*", F.expr(f"inline(array({rows}))"))


def dilate(
    runs: DataFrame, element: Sequence[Row], shape: tuple[int, int, int] | None = None
) -> DataFrame:
    """Union of the mask moved by every offset of the element, cut at ``shape`` if given."""
    moved = _move(runs, element).select(
        "volume_id",
        (F.col("z") + F.col("dz")).alias("z"),
        (F.col("y") + F.col("dy")).alias("y"),
        (F.col("x0") + F.col("lo")).alias("x0"),
        (F.col("x1") + F.col("hi")).alias("x1"),
    )
    if shape is not None:
        depth, height, width = shape
        moved = (
            moved.where(F.col("z").between(0, depth - 1) & F.col("y").between(0, height - 1))
            .withColumn("x0", F.greatest("x0", F.lit(0).cast("bigint")))
            .withColumn("x1", F.least("x1", F.lit(width - 1).cast("bigint")))
            .where("x0 <= x1")
        )
    return _covered(moved, 1)


def erode(runs: DataFrame, element: Sequence[Row]) -> DataFrame:
    """Places where the whole element fits into the mask; outside counts as background."""
    moved = _move(runs, element).select(
        "volume_id",
        (F.col("z") - F.col("dz")).alias("z"),
        (F.col("y") - F.col("dy")).alias("y"),
        (F.col("x0") - F.col("lo")).alias("x0"),
        (F.col("x1") - F.col("hi")).alias("x1"),
    )
    return _covered(moved.where("x0 <= x1"), len(element))


def opening(
    mask: DataFrame, element: Sequence[Row], shape: tuple[int, int, int] | None = None
) -> DataFrame:
    """Erosion, then dilation; the runs in between are staged to keep both plans small."""
    return to_voxels(dilate(stage(erode(to_runs(mask), element), "eroded"), element, shape))


def closing(
    mask: DataFrame, element: Sequence[Row], shape: tuple[int, int, int] | None = None
) -> DataFrame:
    """Dilation, then erosion; the runs in between are staged to keep both plans small."""
    return to_voxels(erode(stage(dilate(to_runs(mask), element, shape), "dilated"), element))


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Voxels before and after, removed and added, with the fractions of the original mask."""
    flagged = (
        before.select(*LINE, "x", F.lit(1).alias("_b"), F.lit(0).alias("_a"))
        .unionByName(after.select(*LINE, "x", F.lit(0).alias("_b"), F.lit(1).alias("_a")))
        .groupBy(*LINE, "x")
        .agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    )
    return (
        flagged.groupBy("volume_id")
        .agg(
            F.sum("_b").alias("voxels_before"),
            F.sum("_a").alias("voxels_after"),
            F.count_if((F.col("_b") == 1) & (F.col("_a") == 0)).alias("voxels_removed"),
            F.count_if((F.col("_b") == 0) & (F.col("_a") == 1)).alias("voxels_added"),
        )
        .withColumn("fraction_removed", F.try_divide("voxels_removed", "voxels_before"))
        .withColumn("fraction_added", F.try_divide("voxels_added", "voxels_before"))
    )
