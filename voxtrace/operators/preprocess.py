"""The fixed slice-preprocessing chain and grouped k-means on intensities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtrace.operators import morphology as morph
from voxtrace.operators.histogram import contrast_stretch, otsu_threshold, value_counts
from voxtrace.operators.volume import SLICE, gaussian_slices, min_max_slices
from voxtrace.session import stage

# Fixed values of the chain.
CHAIN_SIGMA = 2.0
CHAIN_SQUARE = 20
CHAIN_DISK = 25
CLUSTERS = 3
CLUSTER_EPSILON = 0.2


def kmeans_intensities(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    k: int = CLUSTERS,
    epsilon: float = CLUSTER_EPSILON,
) -> DataFrame:
    """(keys, cluster, center, pixels): k-means on one feature, all keys at once.

    Works on counted values, so a round reads distinct values only. Centers start evenly
    spaced over the range of a key; a key is done once no center of it shifts by more than
    ``epsilon``, whatever the other keys do, and all keys are carried on until they are done: the
    squared distances fall in every round, so that happens. A cluster without values keeps its
    center.
    """
    counted = stage(value_counts(df, keys, value), "value-counts")
    step = (F.max("value") - F.min("value")) / k
    start = counted.groupBy(*keys).agg(
        F.array(*[F.min("value") + (i + 0.5) * step for i in range(k)]).alias("centers")
    )
    centers = stage(start.withColumn("done", F.lit(False)), "centers")

    def assign(current: DataFrame) -> DataFrame:
        gaps = F.transform("centers", lambda c: F.abs(c - F.col("value")))
        return counted.join(current, list(keys)).withColumn(
            "cluster", F.array_position(gaps, F.array_min(gaps)).cast("int") - 1
        )

    while True:
        sums = [
            F.try_divide(
                F.sum(F.when(F.col("cluster") == i, F.col("value") * F.col("n"))),
                F.sum(F.when(F.col("cluster") == i, F.col("n"))),
            ).alias(f"_m{i}")
            for i in range(k)
        ]
        moved = assign(centers.where("NOT done")).groupBy(*keys, "centers").agg(*sums)
        fresh = F.array(*[F.coalesce(f"_m{i}", F.get("centers", F.lit(i))) for i in range(k)])
        shift = F.array_max(F.zip_with("centers", "_fresh", lambda a, b: F.abs(a - b)))
        active = moved.withColumn("_fresh", fresh).select(
            *keys, F.col("_fresh").alias("centers"), (shift <= epsilon).alias("done")
        )
        centers = stage(centers.where("done").unionByName(active), "centers")
        if centers.where("NOT done").isEmpty():
            break
    centers = centers.drop("done")
    pixels = assign(centers).groupBy(*keys, "cluster").agg(F.sum("n").alias("pixels"))
    return (
        centers.select(*keys, F.posexplode("centers").alias("cluster", "center"))
        .join(pixels, [*keys, "cluster"], "left")
        .withColumn("pixels", F.coalesce("pixels", F.lit(0).cast("bigint")))
    )


def smallest_cluster(clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounds of the values nearest to the center of the cluster with the fewest pixels.

    One-dimensional clusters are intervals between the midpoints of neighbouring centers.
    """
    per_key = clusters.groupBy(*keys).agg(
        F.array_sort(F.collect_list("center")).alias("_all"),
        F.min_by("center", F.struct("pixels", "cluster")).alias("_own"),
    )  # k values per key
    lower = F.array_max(F.filter("_all", lambda c: c < F.col("_own")))
    upper = F.array_min(F.filter("_all", lambda c: c > F.col("_own")))
    return per_key.select(
        *keys,
        F.coalesce((lower + F.col("_own")) / 2, F.lit(float("-inf"))).alias("low"),
        F.coalesce((upper + F.col("_own")) / 2, F.lit(float("inf"))).alias("high"),
    )


def preprocess_slices(voxels: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """Scale, stretch, smooth, threshold, open, close and mask every slice.

    Returns (volume_id, z, y, x, masked): the stretched intensity inside the mask as a whole
    number, 0 outside. Slices with more non-negative than non-positive pixels are thresholded
    by Otsu; the mask of any other slice is its smallest intensity cluster.
    """
    scaled = stage(min_max_slices(voxels, value, "_unit", 0.0, 255.0), "scaled")
    stretched = stage(
        contrast_stretch(scaled, SLICE, "_unit", "_adj").select(*SLICE, "y", "x", value, "_adj"),
        "stretched",
    )
    smooth = stage(
        gaussian_slices(stretched, "_adj", "_smooth", CHAIN_SIGMA, height, width), "smooth"
    )
    branches = stretched.groupBy(*SLICE).agg(
        (F.count_if(F.col(value) >= 0) > F.count_if(F.col(value) <= 0)).alias("_otsu")
    )
    branches = stage(branches, "branches")
    thresholds = otsu_threshold(smooth, SLICE, "_smooth").select(
        *SLICE, F.col("threshold").alias("low"), F.lit(float("inf")).alias("high")
    )
    bounds = thresholds.join(branches.where("_otsu"), SLICE, "left_semi")
    by_cluster = branches.where("NOT _otsu")
    if not by_cluster.isEmpty():
        others = smooth.join(by_cluster, SLICE, "left_semi")
        clusters = kmeans_intensities(others, SLICE, "_smooth")
        bounds = bounds.unionByName(smallest_cluster(clusters, SLICE))
    inside = (F.col("_smooth") > F.col("low")) & (F.col("_smooth") <= F.col("high"))
    mask = smooth.join(bounds, SLICE).where(inside).select(*SLICE, "y", "x")

    shape = (2**31 - 1, height, width)
    square, disk = morph.square(CHAIN_SQUARE), morph.disk(CHAIN_DISK)
    eroded = stage(morph.erode(morph.to_runs(mask), square), "eroded")
    opened = stage(morph.dilate(eroded, square, shape), "opened")
    closed = morph.to_voxels(morph.erode(stage(morph.dilate(opened, disk, shape), "dilated"), disk))
    kept = closed.withColumn("_in", F.lit(True))
    return stretched.join(kept, [*SLICE, "y", "x"], "left").select(
        *SLICE,
        "y",
        "x",
        F.when(F.col("_in"), F.floor("_adj")).otherwise(0).cast("bigint").alias("masked"),
    )
