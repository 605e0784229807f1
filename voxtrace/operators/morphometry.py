"""Shape measures per lacuna, cross-block de-duplication and density tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtrace.functions.rounding import half_even
from voxtrace.operators.components import component_sizes, label_components, size_filter
from voxtrace.operators.ordered import row_numbers

# Sizes kept as lacunae (both ends included), their connectivity, and the width
# of the border band that disqualifies a component.
LACUNA_MIN, LACUNA_MAX = 58, 899
LACUNA_CONNECTIVITY = 18
BORDER_BAND = 2
# Variances along the longest and the shortest axis that differ by less are equal.
EQUAL_AXES = 1e-8


def select_lacunae(
    labelled: DataFrame, keys: Sequence[str], minimum: int = LACUNA_MIN, maximum: int = LACUNA_MAX
) -> DataFrame:
    """Voxels of the components within the size band."""
    kept = size_filter(component_sizes(labelled, keys), minimum, maximum)
    return labelled.join(kept.select(*keys, "root"), [*keys, "root"], "left_semi")


def lacuna_moments(labelled: DataFrame, keys: Sequence[str], voxel_um: float) -> DataFrame:
    """Voxel count, centroid (counted from 1) and bounding box in micrometres."""
    return labelled.groupBy(*keys, "root").agg(
        F.count("*").alias("voxels"),
        *[(F.sum(a) / F.count("*") + 1).alias(f"centroid_{a}") for a in "xyz"],
        *[((F.max(a) - F.min(a) + 1) * voxel_um).alias(f"bbox_{a}_um") for a in "xyz"],
    )


def _axes_udf(voxel_um: float):
    @F.pandas_udf(
        "struct<stretch double, oblateness double, or1_x double, or1_y double, or1_z double, "
        "or2_x double, or2_y double, or2_z double, major_um double, minor_um double, "
        "axis_ratio double>"
    )
    def axes(
        xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series
    ) -> pd.DataFrame:
        import numpy as np

        matrices = np.empty((len(xx), 3, 3))
        for i, row in enumerate(((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))):
            for j, column in enumerate(row):
                matrices[:, i, j] = column
        values, vectors = np.linalg.eigh(matrices)
        values, vectors = values[:, ::-1], vectors[:, :, ::-1]
        # Rounding makes an empty axis exactly zero; axes closer than EQUAL_AXES have no span.
        values = np.round(np.maximum(values, 0), 9)
        roots = np.sqrt(values)
        span = np.where(values[:, 0] - values[:, 2] < EQUAL_AXES, 0.0, roots[:, 0] - roots[:, 2])
        with np.errstate(divide="ignore", invalid="ignore"):
            stretch = np.where(values[:, 0] > 0, span / roots[:, 0], 0.0)
            flatness = np.where(span != 0, 2 * (roots[:, 1] - roots[:, 2]) / span - 1, 0.0)
            major = values[:, 0] / 2 * voxel_um
            minor = values[:, 2] * voxel_um
            ratio = np.where(major > 0, minor / major, 0.0)
        return pd.DataFrame(
            {
                "stretch": stretch, "oblateness": flatness,
                "or1_x": vectors[:, 0, 0], "or1_y": vectors[:, 1, 0], "or1_z": vectors[:, 2, 0],
                "or2_x": vectors[:, 0, 1], "or2_y": vectors[:, 1, 1], "or2_z": vectors[:, 2, 1],
                "major_um": major, "minor_um": minor, "axis_ratio": ratio,
            }
        )

    return axes


def shape_features(labelled: DataFrame, keys: Sequence[str], voxel_um: float) -> DataFrame:
    """Principal axes of the coordinate covariance of every component.

    The covariances are ordinary aggregates; only the 3x3 eigenvalues are taken in batches
    outside the SQL engine. The sign of an axis is arbitrary. Components as long in all directions
    have a stretch and an oblateness of 0.
    """
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    moments = labelled.groupBy(*keys, "root").agg(
        F.count("*").alias("voxels"),
        *[F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in pairs],
    )
    axes = _axes_udf(voxel_um)(*[F.col(f"_{a}{b}") for a, b in pairs])
    return moments.select(*keys, "root", "voxels", axes.alias("_axes")).select(
        *keys, "root", "voxels", "_axes.*"
    )


def surface_measures(labelled: DataFrame, keys: Sequence[str], voxel_um: float) -> DataFrame:
    """Exposed voxel faces per component, surface area and surface to volume ratios.

    A voxel has six faces; every pair of face neighbours hides two of them.
    """
    steps = F.array(
        *[
            F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("dz", "dy", "dx"), o)])
            for o in ((0, 0, 1), (0, 1, 0), (1, 0, 0))
        ]
    )
    cells = labelled.select(*keys, "root", "z", "y", "x")
    shifted = cells.select(*keys, "root", "z", "y", "x", F.inline(steps)).select(
        *keys, "root", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in "zyx"]
    )
    hidden = (
        shifted.join(cells, [*keys, "root", "z", "y", "x"], "left_semi")
        .groupBy(*keys, "root")
        .agg(F.count("*").alias("_pairs"))
    )
    faces = 6 * F.col("voxels") - 2 * F.coalesce("_pairs", F.lit(0))
    return (
        component_sizes(labelled, keys)
        .join(hidden, [*keys, "root"], "left")
        .withColumn("faces", faces.cast("bigint"))
        .withColumn("surface_um2", F.col("faces") * (voxel_um * voxel_um))
        .withColumn("ratio_raw", F.col("faces") / F.col("voxels"))
        .withColumn("ratio_um", F.col("faces") / F.col("voxels") / voxel_um)
        .drop("_pairs")
    )


def deduplicate_lacunae(
    lacunae: DataFrame, keys: Sequence[str], order: Sequence[str], digits: int = 6
) -> DataFrame:
    """Keep the first lacuna at every rounded centroid and number the rest from 1 per key."""
    place = [half_even(f"centroid_{a}", digits).alias(f"_{a}") for a in "xyz"]
    rest = [c for c in lacunae.columns if c not in keys]
    first = (
        lacunae.groupBy(*keys, *place)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )
    return row_numbers(first, keys, order, "lacuna_id")


def block_density(
    image: DataFrame,
    lacunae: DataFrame,
    thresholds: DataFrame,
    keys: Sequence[str],
    voxel_um: float,
    legacy_units: bool = False,
) -> DataFrame:
    """Lacunar, background and tissue volume per block, lacunae per tissue and fraction.

    ``image`` holds the block's voxels with value ``v``, ``lacunae`` one row per kept lacuna
    with ``voxels``. With ``legacy_units`` the lacunar volume stays a voxel count and is
    subtracted as such.
    """
    cell = voxel_um**3
    background = (
        image.join(thresholds.select(*keys, "threshold"), list(keys))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_voxels"),
            F.count_if(F.col("v") <= F.col("threshold")).alias("_background"),
        )
    )
    counted = lacunae.groupBy(*keys).agg(
        F.count("*").alias("lacunae"), F.sum("voxels").alias("_lacunar")
    )
    lacunar = F.coalesce("_lacunar", F.lit(0)) * F.lit(1.0 if legacy_units else cell)
    tissue = F.col("tissue_um3")
    return (
        background.join(counted, list(keys), "left")
        .withColumn("lacunae", F.coalesce("lacunae", F.lit(0).cast("bigint")))
        .withColumn("lacunar_um3", lacunar)
        .withColumn("background_um3", F.col("_background") * cell)
        .withColumn(
            "tissue_um3", F.col("_voxels") * cell - F.col("background_um3") - F.col("lacunar_um3")
        )
        .withColumn(
            "lacunae_per_tissue", F.when(tissue > 0, F.col("lacunae") / F.nullif(tissue, F.lit(0.0))).otherwise(0.0)
        )
        .withColumn(
            "volume_fraction",
            F.when(tissue > 0, F.col("lacunar_um3") / F.nullif(tissue, F.lit(0.0))).otherwise(0.0),
        )
        .drop("_voxels", "_background", "_lacunar")
    )


def global_density(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total lacunar over total tissue volume; keys without tissue are left out.

    Overlapping blocks count their shared slices once per block.
    """
    return (
        blocks.groupBy(*keys)
        .agg(F.sum("lacunar_um3").alias("lacunar_um3"), F.sum("tissue_um3").alias("tissue_um3"))
        .where("tissue_um3 > 0")
        .withColumn("density", F.col("lacunar_um3") / F.col("tissue_um3"))
    )


def label_lacunae(mask: DataFrame, keys: Sequence[str], shape: tuple[int, int, int]) -> DataFrame:
    """18-connected components of a mask."""
    return label_components(mask, keys, shape, LACUNA_CONNECTIVITY)
