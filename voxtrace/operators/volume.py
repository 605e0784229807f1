"""Volume audits, intensity statistics, per-slice filters and tiling on voxel rows.

A voxel table has ``volume_id, z, y, x`` and a value. Work is keyed by (volume, z) or by
(volume, z, row), never by volume alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtrace.operators.histogram import above_threshold, otsu_threshold, split_counts
from voxtrace.operators.quantiles import exact_percentiles

SLICE = ["volume_id", "z"]

# Bytes per voxel and largest value of the integer types.
ITEM_BYTES = {"uint8": 1, "uint16": 2, "uint32": 4, "int16": 2, "int32": 4, "float32": 4, "float64": 8}
TYPE_MAX = {"uint8": 255, "uint16": 65535}


def geometry(voxels: DataFrame) -> DataFrame:
    """n_slices, height and width per volume."""
    return voxels.groupBy("volume_id").agg(
        (F.max("z") + 1).alias("n_slices"),
        (F.max("y") + 1).alias("height"),
        (F.max("x") + 1).alias("width"),
    )


def bit_depth(voxels: DataFrame, value: str, dtype: str) -> DataFrame:
    """Dynamic range of the first slice and the bit depth it implies."""
    span = F.col("maximum") - F.col("minimum")
    if dtype.startswith("float"):
        depth = F.when(span <= 255, 8).when(span <= 4095, 12).otherwise(16)
    else:
        bits = ITEM_BYTES[dtype] * 8
        depth = (
            F.lit(8)
            if bits <= 8
            else F.when((F.lit(bits) <= 16) & (span <= 4095), 12).otherwise(16)
        )
    # extremes per slice first, so that a volume meets in one small row per slice
    slices = voxels.groupBy("volume_id", "z").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return (
        slices.groupBy("volume_id")
        .agg(F.min_by("low", "z").alias("minimum"), F.min_by("high", "z").alias("maximum"))
        .select(
            "volume_id", span.alias("dynamic_range"), depth.cast("bigint").alias("bit_depth")
        )
    )


def intensity_statistics(voxels: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    v = F.col(value)
    return voxels.groupBy(*keys).agg(
        F.count(v).alias("voxels"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
    )


def decile_signal_to_noise(df: DataFrame, value: str) -> DataFrame:
    """Mean of the top decile over the population std of the bottom decile."""
    cuts = exact_percentiles(df, [], [value], [0.1, 0.9])
    v = F.col(value)
    bounded = df.select(
        v.alias(value), cuts.select(F.struct("p0", "p1")).scalar().alias("_cuts")
    ).select(value, F.col("_cuts.p0").alias("_low"), F.col("_cuts.p1").alias("_high"))
    return bounded.agg(
        F.avg(F.when(v >= F.col("_high"), v)).alias("signal"),
        F.stddev_pop(F.when(v <= F.col("_low"), v)).alias("noise"),
    ).withColumn("snr", F.try_divide("signal", "noise"))


def uncompressed_size(shapes: DataFrame, dtype: str) -> DataFrame:
    cells = F.col("n_slices") * F.col("height") * F.col("width")
    return shapes.select(
        "volume_id", F.round(cells * ITEM_BYTES[dtype] / 1e6, 2).alias("megabytes")
    )


def flat_slices(voxels: DataFrame, value: str, top: float) -> DataFrame:
    """Black slices (maximum 0) and white slices (minimum at the top of the type)."""
    return (
        voxels.groupBy(*SLICE)
        .agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
        .select(
            *SLICE,
            F.when(F.col("_max") == 0, "black").when(F.col("_min") == top, "white").alias("kind"),
        )
        .where(F.col("kind").isNotNull())
    )


def cohort_dimensions(shapes: DataFrame) -> DataFrame:
    """Every sample's height and width, with the cohort size and whether all agree."""
    distinct = shapes.agg(
        F.count("*").alias("n"),
        F.count_distinct(F.struct("height", "width")).alias("sizes"),
    )
    return shapes.select(
        "volume_id",
        "height",
        "width",
        distinct.select("n").scalar().alias("n_samples"),
        (distinct.select("sizes").scalar() == 1).alias("all_same"),
    )


def otsu_slices(voxels: DataFrame, value: str, bins: int | None = 256) -> DataFrame:
    """Threshold per slice with retained count and fraction of the voxels that have a value;
    constant slices are flagged."""
    return (
        split_counts(voxels, SLICE, value, bins)
        .groupBy(*SLICE, "threshold")
        .agg(
            F.sum("n").alias("voxels"),
            F.sum(F.when(above_threshold(), F.col("n")).otherwise(0)).alias("retained"),
            F.max(F.col("min") == F.col("max")).alias("constant"),
        )
        .withColumn("fraction", F.col("retained") / F.col("voxels"))
    )


def apply_otsu(
    voxels: DataFrame,
    value: str,
    out: str,
    mode: str = "binary",
    foreground: float = 1.0,
    background: float = 0.0,
    bins: int | None = 256,
) -> DataFrame:
    """Binary output, or the intensity where it exceeds its slice's threshold and 0 elsewhere."""
    if mode not in {"binary", "masked"}:
        raise ValueError("mode must be binary or masked")
    above = F.col(value) > F.col("threshold")
    shown = (
        F.when(above, F.lit(foreground)).otherwise(F.lit(background))
        if mode == "binary"
        else F.when(above, F.col(value)).otherwise(F.lit(0.0))
    )
    thresholds = otsu_threshold(voxels, SLICE, value, bins).select(*SLICE, "threshold")
    return voxels.join(thresholds, SLICE).withColumn(out, shown).drop("threshold")


def otsu_volume_summary(slices: DataFrame) -> DataFrame:
    """bv_tv per volume; the one reported threshold is that of the last slice."""
    return slices.groupBy("volume_id").agg(
        F.max_by("threshold", "z").alias("otsu_threshold"),
        F.sum("retained").alias("retained"),
        F.sum("voxels").alias("voxels"),
        (F.sum("retained") / F.sum("voxels")).alias("bv_tv"),
        F.count_if(F.col("constant")).alias("constant_slices"),
    )


def bone_volume(
    voxels: DataFrame,
    value: str,
    voxel_size_um: Sequence[float] | None,
    include_zero: bool = False,
    bins: int | None = 256,
) -> DataFrame:
    """Voxels above one threshold per volume, taken over positive voxels unless told otherwise."""
    key = ["volume_id"]
    eligible = None if include_zero else F.col("value") > 0

    def number(of: Column) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(0))

    counted = (
        split_counts(voxels, key, value, bins, eligible)
        .groupBy("volume_id", "threshold")
        .agg(
            F.sum("n").alias("n_total"),
            number(F.col("positive")).alias("n_positive"),
            number(above_threshold()).alias("n_bone"),
        )
    )
    measure = None
    if voxel_size_um is not None:
        measure = 1.0
        for edge in voxel_size_um:
            measure *= edge
    volume = F.col("n_bone") * F.lit(measure).cast("double")
    return counted.withColumn("bone_um3", volume).withColumn("bone_mm3", volume / 1e9)


# Micrometres per header unit.
UNIT_UM = {"meter": 1_000_000.0, "mm": 1_000.0, "micron": 1.0}


def voxel_size(user: Column, header: Column, unit: Column, dimensions: int) -> tuple[Column, Column]:
    """Voxel edge lengths in micrometres and where they came from.

    A user value of the right length with only positive entries beats the header; an unknown
    unit is taken as micrometres.
    """
    def usable(edges: Column) -> Column:
        return (F.size(edges) == dimensions) & F.forall(edges, lambda e: e > 0)

    scale = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in UNIT_UM.items()], F.lit(1.0))
    from_header = F.when(usable(header), F.transform(header, lambda e: e * scale))
    sizes = F.when(user.isNotNull() & usable(user), user).when(user.isNull(), from_header)
    source = (
        F.when(user.isNotNull(), F.when(usable(user), "user").otherwise("invalid_user"))
        .when(from_header.isNotNull(), F.concat(F.lit("header_"), F.coalesce(unit, F.lit("unknown"))))
    )
    return sizes, source


def voxel_measure(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1.0), lambda a, e: a * e)


def min_max_slices(
    voxels: DataFrame,
    value: str,
    out: str,
    low: float = 0.0,
    high: float = 1.0,
    dtype: str = "float32",
) -> DataFrame:
    """Scale every slice to [low, high]; a constant slice becomes ``low``.

    Integer outputs are rounded half to even and clipped.
    """
    ranges = voxels.groupBy(*SLICE).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    span = F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0))
    scaled = F.coalesce(
        (F.col(value) - F.col("_min")) / span * (high - low) + low, F.lit(float(low))
    )
    if dtype in TYPE_MAX:
        scaled = F.least(F.greatest(F.rint(scaled), F.lit(0.0)), F.lit(float(TYPE_MAX[dtype])))
    elif dtype != "float32":
        raise ValueError(f"No rule to store scaled values as {dtype}")
    return voxels.join(ranges, SLICE).withColumn(out, scaled).drop("_min", "_max")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    import math

    radius = int(truncate * sigma + 0.5)
    if radius == 0:
        return [1.0]
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def _line_filter(kernel: list[float], extent: int):
    """Filter of image lines with mirrored borders; places without a voxel count as 0."""
    @F.pandas_udf("array<double>")
    def apply(places: pd.Series, values: pd.Series) -> pd.Series:
        import numpy as np

        weights = np.asarray(kernel)
        radius = len(weights) // 2
        mirror = np.arange(-radius, extent + radius) % (2 * extent)
        mirror = np.where(mirror < extent, mirror, 2 * extent - 1 - mirror)

        def one(place, value):
            line = np.zeros(extent)
            line[np.asarray(place)] = value
            return np.convolve(line[mirror], weights, mode="valid")

        return pd.Series([one(p, v) for p, v in zip(places, values)])

    return apply


def _filter_lines(
    voxels: DataFrame, fixed: str, along: str, value: str, out: str, kernel: list[float], extent: int
) -> DataFrame:
    """One image line per row: bounded by the extent of the image."""
    lines = voxels.groupBy(*SLICE, fixed).agg(F.collect_list(F.struct(along, value)).alias("_line"))
    smooth = _line_filter(kernel, extent)
    return lines.select(
        *SLICE,
        fixed,
        F.posexplode(smooth(F.col(f"_line.{along}"), F.col(f"_line.{value}"))).alias(along, out),
    ).withColumn(along, F.col(along).cast("bigint"))


def gaussian_slices(
    voxels: DataFrame,
    value: str,
    out: str,
    sigma: float,
    height: int,
    width: int,
    source_max: float | None = None,
) -> DataFrame:
    """Separable Gaussian per slice with mirrored borders, cut at four sigma.

    A line of pixels is one row, so each of the two passes shuffles every pixel once. With
    ``source_max`` the result is rounded half to even and clipped to the source type.
    """
    if not 0 <= sigma <= 100:
        raise ValueError("sigma must be within 0..100")
    kernel = gaussian_kernel(sigma) if sigma > 0 else [1.0]
    vertical = _filter_lines(voxels, "x", "y", value, "_v", kernel, height)
    horizontal = _filter_lines(vertical, "y", "x", "_v", out, kernel, width)
    if source_max is not None:
        horizontal = horizontal.withColumn(
            out, F.least(F.greatest(F.rint(out), F.lit(0.0)), F.lit(float(source_max)))
        )
    return horizontal.select(*SLICE, "y", "x", out)


def central_slices(voxels: DataFrame) -> DataFrame:
    """Voxels of slice n_slices // 2 of every volume."""
    middle = voxels.groupBy("volume_id").agg(
        F.floor((F.max("z") + 1) / 2).cast("bigint").alias("z")
    )
    return voxels.join(middle, SLICE, "left_semi")


def gradient_magnitude(voxels: DataFrame, value: str) -> DataFrame:
    """Mean gradient magnitude per slice: central differences, one-sided at the border."""
    def slope(fixed: str, along: str) -> Column:
        line = Window.partitionBy(*SLICE, fixed).orderBy(along)
        before, after = F.lag(value).over(line), F.lead(value).over(line)
        v = F.col(value)
        return F.coalesce((after - before) / 2, after - v, v - before, F.lit(0.0))

    return (
        voxels.withColumn("_gx", slope("y", "x"))
        .withColumn("_gy", slope("x", "y"))
        .groupBy(*SLICE)
        .agg(
            F.avg(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).alias(
                "gradient"
            )
        )
    )


def percentile_clip(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Clip bounds, voxels strictly outside them and their fraction, and the clipped mean."""
    cuts = exact_percentiles(df, [], [value], [low, high])
    v = F.col(value)
    bounded = df.select(
        v.alias(value), cuts.select(F.struct("p0", "p1")).scalar().alias("_cuts")
    ).select(value, F.col("_cuts.p0").alias("_low"), F.col("_cuts.p1").alias("_high"))
    return bounded.agg(
        F.max("_low").alias("lower"),
        F.max("_high").alias("upper"),
        F.count_if((v < F.col("_low")) | (v > F.col("_high"))).alias("clipped"),
        F.count("*").alias("voxels"),
        F.avg(F.least(F.greatest(v, F.col("_low")), F.col("_high"))).alias("clipped_mean"),
    ).withColumn("fraction", F.try_divide("clipped", "voxels"))


def mask_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """identical flag, differing count and fraction of two label masks."""
    both = left.select(*keys, F.col("label").alias("_l")).join(
        right.select(*keys, F.col("label").alias("_r")), list(keys), "full"
    )
    return (
        both.groupBy(keys[0])
        .agg(
            F.count("*").alias("compared"),
            F.count_if(~F.col("_l").eqNullSafe(F.col("_r"))).alias("differing"),
        )
        .withColumn("identical", F.col("differing") == 0)
        .withColumn("fraction", F.col("differing") / F.col("compared"))
    )


def tile_size(height: int, width: int, tiles: int) -> int:
    return max(height // tiles, width // tiles)


def assign_tiles(voxels: DataFrame, height: int, width: int, tiles: int) -> DataFrame:
    """Row and column of the full tile a pixel belongs to; the remainder is dropped."""
    size = tile_size(height, width, tiles)
    rows, columns = height // size, width // size
    return (
        voxels.withColumn("tile_row", F.floor(F.col("y") / size).cast("bigint"))
        .withColumn("tile_col", F.floor(F.col("x") / size).cast("bigint"))
        .where((F.col("tile_row") < rows) & (F.col("tile_col") < columns))
    )


def tissue_tiles(
    voxels: DataFrame, value: str, height: int, width: int, tiles: int
) -> DataFrame:
    """Tiles with any pixel above the Otsu threshold of their slice."""
    thresholds = otsu_threshold(voxels, SLICE, value).select(*SLICE, "threshold")
    return (
        assign_tiles(voxels, height, width, tiles)
        .join(thresholds, SLICE)
        .groupBy(*SLICE, "tile_row", "tile_col")
        .agg(F.avg((F.col(value) > F.col("threshold")).cast("double")).alias("tissue"))
        .where("tissue > 0")
    )


def _covering_tiles(place: Column, extent: int, size: int, overlap_percent: float) -> Column:
    """Numbers of the overlapping tiles that cover a place along one axis.

    Tiles start every stride and are clamped to end inside the extent, so every tile that was
    clamped covers the last ``size`` places.
    """
    if overlap_percent >= 70:
        raise ValueError("Tiles overlap by 70 percent or more")
    if size > extent:
        raise ValueError("A tile must fit into the image")
    stride = size - int(size * overlap_percent / 100)
    count = -(-extent // stride)
    first = F.greatest(F.floor((place - size) / stride) + 1, F.lit(0))
    last = F.when(place >= extent - size, F.lit(count - 1)).otherwise(
        F.least(F.floor(place / stride), F.lit(count - 1))
    )
    return F.sequence(first.cast("bigint"), last.cast("bigint"))


def overlapping_tiles(
    voxels: DataFrame, height: int, width: int, size: int, overlap_percent: float
) -> DataFrame:
    """Every pixel once per overlapping tile that covers it, with the origin of that tile.

    Tile numbers are computed per pixel, so rows grow by the overlap only. Clamped tiles that
    coincide stay apart: a pixel appears once for each.
    """
    stride = size - int(size * overlap_percent / 100)
    rows = _covering_tiles(F.col("y"), height, size, overlap_percent)
    columns = _covering_tiles(F.col("x"), width, size, overlap_percent)
    return (
        voxels.select("*", F.explode(rows).alias("tile_row"))
        .select("*", F.explode(columns).alias("tile_col"))
        .withColumn("y0", F.least(F.col("tile_row") * stride, F.lit(height - size)))
        .withColumn("x0", F.least(F.col("tile_col") * stride, F.lit(width - size)))
    )


def stitch(tiles: DataFrame, value: str) -> DataFrame:
    """Floor of the mean over covering tiles, clipped to 0..255.

    A volume whose largest stitched value is at most 1 is scaled by 255 instead.
    """
    merged = tiles.groupBy(*SLICE, "y", "x").agg(
        F.floor(F.sum(value) / F.count("*")).cast("double").alias("_v")
    )
    peaks = merged.groupBy(*SLICE).agg(F.max("_v").alias("_peak"))
    return (
        merged.join(peaks, SLICE)
        .withColumn(
            "stitched",
            F.when(F.col("_peak") > 1, F.least(F.greatest("_v", F.lit(0.0)), F.lit(255.0)))
            .otherwise(F.col("_v") * 255)
            .cast("bigint"),
        )
        .drop("_v", "_peak")
    )


def z_block_bounds(start: int, end: int, size: int, overlap_percent: float) -> list[tuple[int, int]]:
    """Overlapping blocks [z, min(z + size, end)) until the end is reached."""
    if overlap_percent >= 100:
        raise ValueError("Blocks must overlap by less than their whole size")
    step = size - int(size * overlap_percent / 100)
    if step <= 0:
        raise ValueError(f"Blocks of {size} slices never advance at {overlap_percent} percent overlap")
    last = max(0, -(-(end - start - size) // step))
    return [
        (start + i * step, min(start + i * step + size, end)) for i in range(last + 1)
    ] if end > start else []


def z_blocks(
    voxels: DataFrame, start: int, end: int, size: int, overlap_percent: float
) -> DataFrame:
    """Replicate voxels to every z-block that holds them: an arithmetic range join.

    Only the blocks around a voxel's own z are generated, so the row count grows by the
    overlap and not by the number of blocks.
    """
    bounds = z_block_bounds(start, end, size, overlap_percent)
    step = size - int(size * overlap_percent / 100)
    z = F.col("z") - start
    first = F.greatest(F.floor((z - size) / step) + 1, F.lit(0))
    last = F.least(F.floor(z / step), F.lit(len(bounds) - 1))
    inside = voxels.where((F.col("z") >= start) & (F.col("z") < end))
    return (
        inside.select("*", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("block", F.col("block").cast("bigint"))
        .withColumn("z_start", F.col("block") * step + start)
        .withColumn("z_end", F.least(F.col("z_start") + size, F.lit(end)))
    )
