"""Connected components of foreground voxels, at any volume size.

Voxels are labelled inside cubes of a fixed edge, so a task never sees more than one cube.
Labels that touch across cube faces give edges of a much smaller graph, which is contracted
by repeated minimum labels with pointer jumping. A component may span every cube of a volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtrace.operators.ordered import row_numbers, salted_lookup
from voxtrace.session import stage

# How many axes a neighbour may differ in, per connectivity.
AXES_2D = {4: 1, 8: 2}
AXES_3D = {6: 1, 18: 2, 26: 3}
DEFAULT_2D, DEFAULT_3D = 8, 26


def neighbour_offsets(dimensions: int, connectivity: int | None) -> list[tuple[int, int, int]]:
    """All (dz, dy, dx) neighbours of a voxel, without the voxel itself."""
    if dimensions == 2:
        axes = AXES_2D.get(connectivity or DEFAULT_2D)
        if axes is None:
            raise ValueError(f"Planar connectivity is one of {sorted(AXES_2D)}")
    elif dimensions == 3:
        axes = AXES_3D.get(connectivity or DEFAULT_3D)
        if axes is None:
            raise ValueError(f"Spatial connectivity is one of {sorted(AXES_3D)}")
    else:
        raise ValueError(f"Components need 2 or 3 dimensions; got {dimensions}.")
    steps = (-1, 0, 1)
    return [
        (dz, dy, dx)
        for dz in (steps if dimensions == 3 else (0,))
        for dy in steps
        for dx in steps
        if 0 < abs(dz) + abs(dy) + abs(dx) <= axes
    ]


def _forward(offsets: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return [o for o in offsets if o > (0, 0, 0)]


def _cube_labeller(forward, edge):
    """Label the voxels of one cube with the smallest linear index of their component."""

    def label(frame):
        import numpy as np

        z, y, x = (frame[c].to_numpy() for c in ("z", "y", "x"))
        index = frame["voxel"].to_numpy()
        place = ((z % edge) * edge + y % edge) * edge + x % edge
        slot = np.full(edge**3, -1, dtype=np.int64)
        slot[place] = np.arange(len(frame))
        pairs = []
        for dz, dy, dx in forward:
            tz, ty, tx = z % edge + dz, y % edge + dy, x % edge + dx
            inside = (
                (tz >= 0) & (tz < edge) & (ty >= 0) & (ty < edge) & (tx >= 0) & (tx < edge)
            )
            target = slot[((tz * edge + ty) * edge + tx)[inside]]
            source = np.flatnonzero(inside)
            hit = target >= 0
            pairs.append(np.stack([source[hit], target[hit]]))
        pairs = np.concatenate(pairs, axis=1)
        labels = index.copy()
        order = np.argsort(index)
        ranked = index[order]
        while True:
            before = labels.copy()
            low = np.minimum(labels[pairs[0]], labels[pairs[1]])
            np.minimum.at(labels, pairs[0], low)
            np.minimum.at(labels, pairs[1], low)
            labels = labels[order[np.searchsorted(ranked, labels)]]
            if np.array_equal(before, labels):
                break
        frame["node"] = labels
        return frame

    return label


def label_components(
    voxels: DataFrame,
    keys: Sequence[str],
    shape: tuple[int, int, int],
    connectivity: int | None = None,
    dimensions: int = 3,
    edge: int = 64,
) -> DataFrame:
    """Add ``root``, the smallest linear index (z, y, x order) of the voxel's component.

    ``keys`` separate volumes (and classes, or blocks); voxels of different keys never touch.
    """
    depth, height, width = shape
    offsets = neighbour_offsets(dimensions, connectivity)
    forward = _forward(offsets)
    columns = [*voxels.columns]
    cubes = [f"_c{a}" for a in "zyx"]
    placed = voxels.withColumn(
        "voxel", ((F.col("z") * height + F.col("y")) * width + F.col("x")).cast("bigint")
    )
    for axis, cube in zip("zyx", cubes):
        placed = placed.withColumn(cube, F.floor(F.col(axis) / edge).cast("int"))
    labeller = _cube_labeller(forward, edge)
    schema = placed.withColumn("node", F.lit(0).cast("bigint")).schema
    # An explicit partition count: adaptive execution would fold small cubes into few tasks.
    tasks = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.repartition(tasks, *keys, *cubes)
    nodes = stage(spread.groupBy(*keys, *cubes).applyInPandas(labeller, schema), "cube-labels")
    if depth <= edge and height <= edge and width <= edge:
        return nodes.select(*columns, "voxel", F.col("node").alias("root"))

    edges = _face_edges(nodes, keys, forward, edge)
    roots = _contract(edges, keys)
    return (
        salted_lookup(nodes, roots, [*keys, "node"], ["voxel"], "left")
        .withColumn("root", F.coalesce("root", "node"))
        .select(*columns, "voxel", "root")
    )


def _face_edges(nodes: DataFrame, keys, forward, edge: int) -> DataFrame:
    """Pairs of cube labels that touch across a cube face, each once."""
    on_face = F.lit(False)
    for axis in "zyx":
        rest = F.pmod(F.col(axis), F.lit(edge))
        on_face = on_face | (rest == 0) | (rest == edge - 1)
    face = nodes.where(on_face).select(*keys, "z", "y", "x", "node")
    steps = F.array(
        *[
            F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("dz", "dy", "dx"), o)])
            for o in forward
        ]
    )
    cube_changes = F.lit(False)
    for axis in "zyx":
        cube_changes = cube_changes | (
            F.floor((F.col(axis) + F.col(f"d{axis}")) / edge) != F.floor(F.col(axis) / edge)
        )
    reached = (
        face.select("*", F.inline(steps))
        .where(cube_changes)
        .select(
            *keys,
            F.col("node").alias("a"),
            *[(F.col(axis) + F.col(f"d{axis}")).alias(axis) for axis in "zyx"],
        )
    )
    return (
        reached.join(face.withColumnRenamed("node", "b").hint("merge"), [*keys, "z", "y", "x"])
        .where("a <> b")
        .select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _contract(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node of every connected node, by minimum labels and pointer jumping.

    Staged labels compress to a small part of their rows, so their files' sizes say nothing of a
    broadcast: all joins shuffle, and no round sends a table to the driver.
    """
    both = stage(
        edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).union(
            edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"))
        ),
        "face-edges",
    )
    roots = both.groupBy(*keys, "node").agg(F.least("node", F.min("other")).alias("root"))
    roots = stage(roots, "roots")
    while True:
        seen = both.join(
            roots.select(*keys, F.col("node").alias("other"), F.col("root").alias("near")).hint("merge"),
            [*keys, "other"],
        )
        lowest = seen.groupBy(*keys, "node").agg(F.min("near").alias("near"))
        lowered = roots.join(lowest.hint("merge"), [*keys, "node"]).select(
            *keys, "node", F.col("root").alias("was"), F.least("root", "near").alias("mid")
        )
        jump = roots.select(*keys, F.col("node").alias("mid"), F.col("root").alias("far"))
        jumped = stage(
            salted_lookup(lowered, jump, [*keys, "mid"], ["node"], "left").select(
                *keys, "node", "was", F.least("mid", F.coalesce("far", "mid")).alias("root")
            ),
            "roots",
        )
        roots = jumped.drop("was")
        if jumped.where("root <> was").isEmpty():
            return roots


def component_sizes(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, root, voxels)."""
    return labelled.groupBy(*keys, "root").agg(F.count("*").alias("voxels"))


def number_components(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Component ids 1..n per key in scan order; filters keep these numbers."""
    return row_numbers(sizes, keys, ["root"], "component_id")


def size_filter(
    sizes: DataFrame, minimum: int | None = None, maximum: int | None = None
) -> DataFrame:
    kept = sizes
    if minimum is not None:
        kept = kept.where(F.col("voxels") >= minimum)
    if maximum is not None:
        kept = kept.where(F.col("voxels") <= maximum)
    return kept


def component_table(
    sizes: DataFrame,
    keys: Sequence[str],
    measure_um: float | None,
    minimum: int | None = None,
    maximum: int | None = None,
) -> DataFrame:
    """Per-component rows of the kept components, with their volume."""
    return size_filter(number_components(sizes, keys), minimum, maximum).select(
        *keys,
        "component_id",
        F.col("voxels").alias("voxel_count"),
        (F.col("voxels") * F.lit(measure_um).cast("double")).alias("volume_um3"),
        F.lit(True).alias("included_after_filtering"),
    )


def component_totals(
    sizes: DataFrame,
    keys: Sequence[str],
    measure_um: float | None,
    minimum: int | None = None,
    maximum: int | None = None,
) -> DataFrame:
    """Counts before and after the size filter and the kept volume."""
    kept = F.lit(True)
    if minimum is not None:
        kept = kept & (F.col("voxels") >= minimum)
    if maximum is not None:
        kept = kept & (F.col("voxels") <= maximum)
    return (
        sizes.groupBy(*keys)
        .agg(
            F.count_if(kept).alias("n_components"),
            F.count("*").alias("n_before"),
            F.coalesce(F.sum(F.when(kept, F.col("voxels"))), F.lit(0).cast("bigint")).alias(
                "total_voxels"
            ),
            F.max(F.when(kept, F.col("voxels"))).alias("largest"),
        )
        .withColumn("n_removed", F.col("n_before") - F.col("n_components"))
        .withColumn("total_um3", F.col("total_voxels") * F.lit(measure_um).cast("double"))
    )


def touching_border(
    labelled: DataFrame, keys: Sequence[str], shape: tuple[int, int, int], band: int
) -> DataFrame:
    """Components with a voxel within ``band`` of any face of the volume."""
    near = F.lit(False)
    for axis, extent in zip("zyx", shape):
        near = near | (F.col(axis) < band) | (F.col(axis) >= extent - band)
    return labelled.where(near).select(*keys, "root").distinct()


def clear_border(
    labelled: DataFrame, keys: Sequence[str], shape: tuple[int, int, int], band: int = 2
) -> DataFrame:
    """Remove every component that touches the border band."""
    return labelled.join(touching_border(labelled, keys, shape, band), [*keys, "root"], "left_anti")


