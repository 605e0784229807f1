"""Surface area and volume of components on a triangle mesh, without building the mesh.

The surface runs half-way between voxels inside and outside of a component. It is cut by the
cells between voxel centres, each with eight voxels as corners, so what a cell holds depends on
its configuration number alone: one bit for each corner inside. Spark counts the cells of each
configuration per component; a table of 256 rows gives area and enclosed volume of one cell.

The table follows from a rule. On every face of a cell, each run of outside corners is cut off by
one segment, so inside corners that touch along an edge only stay together, as components of
connectivity 18 do. Segments join to loops, and a loop is cut into triangles from that corner
which gives the least area. Voxels have edges of one; a single voxel has an area of sqrt(3) and a
volume of 1/6.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtrace.operators.components import component_sizes
from voxtrace.operators.ordered import dealt
from voxtrace.session import stage

CORNERS = list(product((0, 1), repeat=3))  # (z, y, x); the corner's bit is its place here


def _faces() -> list[list[int]]:
    """Corners of the six faces, all in the same sense seen from outside."""
    found = []
    for axis, side in product(range(3), (0, 1)):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
        if side == 0:
            ring.reverse()
        corners = []
        for a, b in ring:
            place = [0, 0, 0]
            place[axis], place[u], place[v] = side, a, b
            corners.append(CORNERS.index(tuple(place)))
        found.append(corners)
    return found


FACES = _faces()


def loops(number: int) -> list[np.ndarray]:
    """Closed polygons of the surface in a cell, as points half-way along its edges."""
    inside = [bool(number >> k & 1) for k in range(8)]
    following = {}
    for face in FACES:
        for k in range(4):
            before, corner = face[k - 1], face[k]
            if inside[before] and not inside[corner]:
                # walk over the outside corners to where the face goes inside again
                last = k
                while not inside[face[(last + 1) % 4]]:
                    last += 1
                end = frozenset((face[last % 4], face[(last + 1) % 4]))
                following[frozenset((before, corner))] = end
    out = []
    while following:
        start, edge = None, next(iter(following))
        loop = []
        while edge != start:
            start = start or edge
            loop.append(np.mean([CORNERS[c] for c in edge], axis=0))
            edge = following.pop(edge)
        out.append(np.array(loop[::-1]))
    return out


def triangles(number: int) -> np.ndarray:
    """Triangles (n, 3, 3) of the surface in a cell, seen from outside in the same sense."""
    out = [np.zeros((0, 3, 3))]
    for loop in loops(number):
        fans = []
        for k in range(len(loop)):
            turned = np.roll(loop, -k, axis=0)
            fans.append(np.array([[turned[0], turned[i], turned[i + 1]] for i in range(1, len(loop) - 1)]))
        areas = [round(float(np.linalg.norm(normals(f), axis=1).sum()), 9) for f in fans]
        out.append(fans[int(np.argmin(areas))])
    return np.concatenate(out)


def normals(found: np.ndarray) -> np.ndarray:
    """Normals of triangles, as long as their areas."""
    return np.cross(found[:, 1] - found[:, 0], found[:, 2] - found[:, 0]) / 2


def _inside_share(number: int) -> float:
    """Share of the cell's far face (z = 1) that lies inside: corners cut off are eighths."""
    face = FACES[1]
    out = [k for k in range(4) if not number >> face[k] & 1]
    if len(out) == 2 and (out[1] - out[0]) % 2:
        return 0.5
    return {0: 1.0, 1: 7 / 8, 2: 3 / 4, 3: 1 / 8, 4: 0.0}[len(out)]


@cache
def cell_table() -> list[tuple[int, float, float]]:
    """(configuration, area, volume) of every cell that holds any of a component."""
    rows = []
    for number in range(1, 256):
        found = triangles(number)
        across = normals(found)
        area = float(np.linalg.norm(across, axis=1).sum())
        # flux of (z, 0, 0) through the surface and the far face is the volume
        volume = float((found[:, :, 0].mean(axis=1) * across[:, 0]).sum()) + _inside_share(number)
        rows.append((number, area, volume))
    return rows


def cell_counts(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, root, configuration, cells): cells of each configuration, by one explode of voxels.

    Cells are dealt to tasks by their place, so neither a large component nor a file split is one
    task's table.
    """
    corners = F.array(
        *[
            F.struct(
                *[F.lit(o).cast("bigint").alias(f"d{a}") for a, o in zip("zyx", corner, strict=True)],
                F.lit(1 << k).alias("bit"),
            )
            for k, corner in enumerate(CORNERS)
        ]
    )
    place = [*keys, "root", "z", "y", "x"]
    bits = labelled.select(*keys, "root", "z", "y", "x", F.inline(corners)).select(
        *keys, "root", *[(F.col(a) - F.col(f"d{a}")).alias(a) for a in "zyx"], "bit"
    )
    cells = dealt(bits, place).groupBy(*place).agg(F.bit_or("bit").alias("configuration"))
    return cells.groupBy(*keys, "root", "configuration").agg(F.count("*").alias("cells"))


def mesh_measures(labelled: DataFrame, keys: Sequence[str], voxel_um: float) -> DataFrame:
    """Mesh area and volume of each component, in voxels and micrometres, and their ratios.

    ``mesh_ratio_raw`` is area over mesh volume, ``mesh_ratio_um`` area over the volume of the
    voxels. Neighbouring components do not hide parts of each other's surface.
    """
    spark = labelled.sparkSession
    labelled = stage(labelled.select(*keys, "root", "z", "y", "x"), "mesh-voxels")
    table = spark.createDataFrame(cell_table(), "configuration int, area double, inside double")
    summed = (
        cell_counts(labelled, keys)
        .join(F.broadcast(table), "configuration")  # 255 rows
        .groupBy(*keys, "root")
        .agg(
            F.sum(F.col("cells") * F.col("area")).alias("mesh_area"),
            F.sum(F.col("cells") * F.col("inside")).alias("mesh_volume"),
        )
    )
    return (
        component_sizes(labelled, keys)
        .join(summed, [*keys, "root"])
        .withColumn("mesh_area_um2", F.col("mesh_area") * voxel_um**2)
        .withColumn("mesh_volume_um3", F.col("mesh_volume") * voxel_um**3)
        .withColumn("mesh_ratio_raw", F.col("mesh_area") / F.col("mesh_volume"))
        .withColumn("mesh_ratio_um", F.col("mesh_area_um2") / (F.col("voxels") * voxel_um**3))
    )
