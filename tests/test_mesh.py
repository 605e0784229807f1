"""Mesh measures against triangles placed in the volume, and known bodies."""

import numpy as np
import pandas as pd
import pytest

from voxtrace.operators import mesh
from voxtrace.operators.components import label_components

KEYS = ["volume_id"]


def placed_triangles(mask):
    """All triangles of a mask's surface, in the volume's coordinates."""
    padded = np.pad(mask, 1)
    out = []
    for place in np.ndindex(*(s - 1 for s in padded.shape)):
        number = sum(1 << k for k, c in enumerate(mesh.CORNERS) if padded[tuple(np.add(place, c))])
        found = mesh.triangles(number)
        out.append(found + np.array(place))
    return np.concatenate(out)


def area_and_volume(found):
    area = np.linalg.norm(mesh.normals(found), axis=1).sum()
    return area, np.linalg.det(found).sum() / 6


def measures(spark, mask, voxel_um=1.0, connectivity=18, moved=0):
    z, y, x = np.nonzero(mask)
    voxels = spark.createDataFrame(
        pd.DataFrame({"volume_id": 1, "z": z + moved, "y": y + moved, "x": x + moved}),
        "volume_id bigint, z bigint, y bigint, x bigint",
    )
    shape = tuple(s + moved for s in mask.shape)
    labelled = label_components(voxels, KEYS, shape, connectivity)
    return mesh.mesh_measures(labelled, KEYS, voxel_um).orderBy("root").collect()


def ball(radius):
    axis = np.arange(-radius, radius + 1)
    z, y, x = np.meshgrid(axis, axis, axis, indexing="ij")
    return z * z + y * y + x * x <= radius * radius


def test_every_configuration_closes_and_matches_its_complement():
    table = {n: (a, v) for n, a, v in mesh.cell_table()}
    assert len(table) == 255 and table[255] == (0.0, 1.0)
    for number in range(1, 255):
        area, volume = table[number]
        assert area > 0 and 0 < volume < 1
        # every edge of the surface that is not on a face of the cell belongs to two triangles, once each way
        sides = {}
        for t in mesh.triangles(number):
            for k in range(3):
                a, b = tuple(t[k]), tuple(t[(k + 1) % 3])
                sides[a, b] = sides.get((a, b), 0) + 1
        for (a, b), n in sides.items():
            on_face = any(a[i] == b[i] and a[i] in (0, 1) for i in range(3))
            assert n == 1 and ((b, a) in sides or on_face)


def test_known_bodies(spark):
    one = np.ones((1, 1, 1), bool)
    (r,) = measures(spark, one, voxel_um=2.0)
    assert r.mesh_area == pytest.approx(3**0.5) and r.mesh_volume == pytest.approx(1 / 6)
    assert r.mesh_area_um2 == pytest.approx(4 * 3**0.5) and r.mesh_volume_um3 == pytest.approx(8 / 6)
    assert r.mesh_ratio_raw == pytest.approx(6 * 3**0.5) and r.mesh_ratio_um == pytest.approx(3**0.5 / 2)
    (r,) = measures(spark, np.ones((4, 4, 4), bool))
    # six faces of 3 x 3, twelve bevelled edges, eight corners
    assert r.mesh_area == pytest.approx(6 * 9 + 12 * 3 * 0.5**0.5 + 8 * 3**0.5 / 8)
    assert r.voxels == 64 and r.mesh_volume < 64
    assert r.mesh_volume == pytest.approx(27 + 6 * 9 / 2 + 12 * 3 / 8 + 8 / 48)


@pytest.mark.parametrize("moved", [0, 100_000])
def test_balls_and_noise_match_placed_triangles(spark, moved):
    rng = np.random.default_rng(4)
    for mask in (ball(4), rng.random((6, 7, 5)) < 0.6):
        (found,) = measures(spark, mask, connectivity=26, moved=moved)
        area, volume = area_and_volume(placed_triangles(mask))
        assert found.mesh_area == pytest.approx(area) and found.mesh_volume == pytest.approx(volume)
    area, volume = area_and_volume(placed_triangles(ball(4)))
    assert 0.9 < volume / ball(4).sum() < 1 and 1 < area / (4 * np.pi * 16) < 1.15


def test_components_keep_their_own_surface(spark):
    mask = np.zeros((6, 6, 6), bool)
    mask[1:3, 1:3, 1:3] = True
    mask[3:5, 3:5, 3:5] = True  # touches by a corner only
    found = measures(spark, mask)
    alone = measures(spark, np.ones((2, 2, 2), bool))[0]
    assert len(found) == 2
    for r in found:
        assert r.mesh_area == pytest.approx(alone.mesh_area) and r.mesh_volume == pytest.approx(alone.mesh_volume)
    assert measures(spark, np.zeros((2, 2, 2), bool)) == []


def test_cells_are_dealt_before_they_are_grouped(spark, capsys):
    """The upstream partitions hold whole components, which a task would group at once."""
    voxels = spark.range(0, 3).selectExpr("1L AS volume_id", "0L AS root", "id AS z", "0L AS y", "0L AS x")
    mesh.cell_counts(voxels.repartition(2, "volume_id", "root"), ["volume_id"]).explain()
    below = capsys.readouterr().out.split("REPARTITION_BY_NUM")
    assert len(below) == 3 and "Aggregate" not in below[1]
