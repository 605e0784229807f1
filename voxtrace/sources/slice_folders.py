"""Folders of slices as volumes: order, the rule of equal shapes, voxels.

A slice is a row (folder, name, height, width, pixels) with row-major pixels; it may come from
Parquet or from any reader of single images. Order and shapes are settled without the pixels,
which move once, by folder and name, so a folder may hold any number of slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtrace.sources.catalog import order_slices

OK, EMPTY, UNEQUAL, BROKEN, REPEATED, UNNUMBERED = (
    "ok", "no_slices", "unequal_shapes", "broken_slice", "repeated_slice", "missing_index",
)


def _names(slices: DataFrame) -> DataFrame:
    """Shape and soundness of each (folder, name), without pixels."""
    height, width = (F.col(c).cast("bigint") for c in ("height", "width"))
    sound = F.col("name").isNotNull() & (height > 0) & (width > 0) & (F.size("pixels") == height * width)
    plain = slices.where(F.col("folder").isNotNull()).select(
        "folder", "name", height.alias("height"), width.alias("width"), F.coalesce(sound, F.lit(False)).alias("sound")
    )
    return plain.groupBy("folder", "name").agg(
        F.count("*").alias("rows"),
        F.bool_and("sound").alias("sound"),
        *[f(c).alias(f"{n}_{c}") for c in ("height", "width") for n, f in (("min", F.min), ("max", F.max))],
    )


def volume_report(slices: DataFrame, mode: str = "auto", folders: DataFrame | None = None) -> DataFrame:
    """One row per folder: slices, shape (null where slices differ) and why it is no volume.

    ``folders`` names folders that must appear even without a slice; slices without a folder take
    no part. Of several reasons the first of these counts: no slices; a slice without a name, or
    whose pixels are null or don't fill its shape; unequal shapes; names without a number (in
    numeric order only); a name or number that occurs twice.
    """
    names = _names(slices)
    shapes = names.groupBy("folder").agg(
        F.sum("rows").alias("slices"),
        F.bool_and("sound").alias("sound"),
        F.bool_or(F.col("rows") > 1).alias("twice"),
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("height", "width") for n, f in (("min", F.min), ("max", F.max))],
    )
    order = (
        order_slices(names.where("name IS NOT NULL").select("folder", "name"), "folder", "name", mode)
        .groupBy("folder")
        .agg(F.bool_or("duplicate").alias("same_number"), F.bool_or("unnumbered_error").alias("unnumbered"))
    )
    known = shapes.join(order, "folder", "left")
    if folders is not None:
        known = folders.select("folder").where("folder IS NOT NULL").distinct().join(known, "folder", "full")
    count = F.coalesce("slices", F.lit(0)).cast("bigint")
    differ = (F.col("min_height") != F.col("max_height")) | (F.col("min_width") != F.col("max_width"))
    status = (
        F.when(count == 0, EMPTY)
        .when(~F.col("sound"), BROKEN)
        .when(differ, UNEQUAL)
        .when(F.col("unnumbered"), UNNUMBERED)
        .when(F.col("twice") | F.col("same_number"), REPEATED)
        .otherwise(OK)
    )
    same = [F.when(F.col(f"min_{c}") == F.col(f"max_{c}"), F.col(f"min_{c}")).alias(c) for c in ("height", "width")]
    return known.select("folder", count.alias("depth"), *same, status.alias("status"))


def folder_volumes(slices: DataFrame, mode: str = "auto") -> DataFrame:
    """(volume_id, z, height, width, pixels) of the folders that are volumes; z counts from 0.

    Folders with another status than ``ok`` have no rows here; ``volume_report`` says why.
    """
    good = volume_report(slices, mode).where(F.col("status") == OK).select("folder")
    names = slices.select("folder", "name").join(good, "folder", "left_semi")
    placed = order_slices(names, "folder", "name", mode).select("folder", "name", "position")
    return slices.join(placed, ["folder", "name"]).select(
        F.col("folder").alias("volume_id"),
        (F.col("position") - 1).alias("z"),
        F.col("height").cast("bigint").alias("height"),
        F.col("width").cast("bigint").alias("width"),
        "pixels",
    )
