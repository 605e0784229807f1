"""Connected components and shapes against a flood fill, for any cube size."""

from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtrace.functions.text import sample_id
from voxtrace.operators import components as comp
from voxtrace.operators import morphometry as morpho
from voxtrace.plans import component_plans
from voxtrace.session import stage

KEYS = ["volume_id"]


def rows(spark, mask, volume=1):
    z, y, x = np.nonzero(mask)
    return spark.createDataFrame(
        pd.DataFrame({"volume_id": volume, "z": z, "y": y, "x": x}),
        "volume_id bigint, z bigint, y bigint, x bigint",
    )


def flood(mask, offsets):
    roots, shape = {}, mask.shape
    for start in map(tuple, np.argwhere(mask)):
        if start in roots:
            continue
        index = int(np.ravel_multi_index(start, shape))
        todo, roots[start] = [start], index
        while todo:
            at = todo.pop()
            for o in offsets:
                t = tuple(a + b for a, b in zip(at, o))
                if all(0 <= a < b for a, b in zip(t, shape)) and mask[t] and t not in roots:
                    roots[t] = index
                    todo.append(t)
    return {int(np.ravel_multi_index(p, shape)): r for p, r in roots.items()}


@pytest.mark.parametrize("connectivity", [6, 18, 26])
@pytest.mark.parametrize("edge", [3, 5, 64])
def test_labels_do_not_depend_on_cubes(spark, connectivity, edge):
    mask = np.random.default_rng(connectivity).random((9, 10, 11)) < (0.3 if connectivity == 6 else 0.13)
    got = comp.label_components(rows(spark, mask), KEYS, mask.shape, connectivity, edge=edge)
    want = flood(mask, comp.neighbour_offsets(3, connectivity))
    assert {r["voxel"]: r["root"] for r in got.collect()} == want


def test_snake_through_every_cube(spark):
    mask = np.zeros((1, 16, 16), dtype=bool)
    mask[0, ::2, :] = True
    for i, y in enumerate(range(1, 16, 2)):
        mask[0, y, 15 if i % 2 == 0 else 0] = True
    got = comp.label_components(rows(spark, mask), KEYS, mask.shape, 6, edge=2)
    assert {r["root"] for r in got.collect()} == {0}


def test_corner_contact_depends_on_connectivity(spark):
    mask = np.zeros((2, 2, 2), dtype=bool)
    mask[0, 0, 0] = mask[1, 1, 1] = True
    for connectivity, n in ((6, 2), (18, 2), (26, 1), (None, 1)):
        labelled = comp.label_components(rows(spark, mask), KEYS, mask.shape, connectivity)
        assert labelled.select("root").distinct().count() == n
    flat = np.zeros((1, 2, 2), dtype=bool)
    flat[0, 0, 0] = flat[0, 1, 1] = True
    for connectivity, n in ((4, 2), (8, 1), (None, 1)):
        labelled = comp.label_components(rows(spark, flat), KEYS, flat.shape, connectivity, 2)
        assert labelled.select("root").distinct().count() == n
    for bad in ((3, 8), (2, 6), (4, None)):
        with pytest.raises(ValueError):
            comp.neighbour_offsets(*bad)


def test_sizes_ids_totals_and_limits(spark):
    mask = np.zeros((1, 5, 1000), dtype=bool)
    mask[0, 0, :57] = mask[0, 2, :58] = mask[0, 2, 60:959] = mask[0, 4, :900] = True
    labelled = comp.label_components(rows(spark, mask), KEYS, mask.shape, 18)
    sizes = comp.component_sizes(labelled, KEYS)
    kept = comp.component_table(sizes, KEYS, 2.0, morpho.LACUNA_MIN, morpho.LACUNA_MAX).collect()
    assert {r["component_id"]: r["voxel_count"] for r in kept} == {2: 58, 3: 899}
    totals = comp.component_totals(sizes, KEYS, 2.0, 58, 899).head()
    assert (totals["n_components"], totals["n_before"], totals["n_removed"]) == (2, 4, 2)
    assert totals["total_um3"] == 2.0 * (58 + 899)
    assert sizes.agg(F.sum("voxels")).head()[0] == mask.sum()


def test_border_and_empty_mask(spark):
    mask = np.zeros((9, 9, 9), dtype=bool)
    mask[4, 4, 4] = mask[1, 4, 4] = mask[4, 4, 7] = mask[4, 6, 4] = True
    labelled = comp.label_components(rows(spark, mask), KEYS, mask.shape)
    inside = comp.clear_border(labelled, KEYS, mask.shape).collect()
    assert sorted((r["z"], r["y"], r["x"]) for r in inside) == [(4, 4, 4), (4, 6, 4)]
    empty = comp.label_components(rows(spark, np.zeros((2, 2, 2), dtype=bool)), KEYS, (2, 2, 2))
    assert empty.count() == 0


def test_shapes_match_numpy(spark):
    rng = np.random.default_rng(4)
    mask = np.zeros((12, 12, 12), dtype=bool)
    mask[2:9, 3:6, 2:4] = True
    mask[10, 10, 10] = True
    mask[2:9, 3:6, 2:4] &= rng.random((7, 3, 2)) < 0.95
    labelled = comp.label_components(rows(spark, mask), KEYS, mask.shape, 26)
    got = {r["root"]: r for r in morpho.shape_features(labelled, KEYS, 1.6).collect()}
    for root, r in got.items():
        points = np.array([(v["x"], v["y"], v["z"]) for v in labelled.where(F.col("root") == root).collect()])
        values = np.sort(np.linalg.eigvalsh(np.cov(points.T, bias=True)))[::-1] if len(points) > 1 else np.zeros(3)
        roots = np.sqrt(np.maximum(values, 0))
        if len(points) == 1:
            assert (r["stretch"], r["oblateness"], r["axis_ratio"]) == (0, 0, 0)
            continue
        assert np.isclose(r["stretch"], (roots[0] - roots[2]) / roots[0])
        assert np.isclose(r["oblateness"], 2 * (roots[1] - roots[2]) / (roots[0] - roots[2]) - 1)
        assert np.isclose(r["major_um"], values[0] / 2 * 1.6) and np.isclose(r["minor_um"], values[2] * 1.6)
        axis = np.array([r["or1_x"], r["or1_y"], r["or1_z"]])
        assert np.isclose(np.linalg.norm(np.cov(points.T, bias=True) @ axis), values[0])
    surfaces = {r["root"]: r for r in morpho.surface_measures(labelled, KEYS, 2.0).collect()}
    padded = np.pad(mask, 1)
    faces = sum(int((padded & ~np.roll(padded, s, a)).sum()) for a in range(3) for s in (1, -1))
    assert sum(r["faces"] for r in surfaces.values()) == faces
    assert surfaces[max(surfaces)]["faces"] == 6 and surfaces[max(surfaces)]["ratio_um"] == 3.0


def test_deduplication_keeps_first_block(spark):
    df = spark.createDataFrame(
        [(1, 1, 5, 2.0, 1.0000001, 3.0), (1, 0, 9, 2.0, 1.0000002, 3.0), (1, 2, 4, 2.0, 1.1, 3.0)],
        "volume_id int, block int, root int, centroid_x double, centroid_y double, centroid_z double",
    )
    got = morpho.deduplicate_lacunae(df, KEYS, ["block", "root"]).orderBy("lacuna_id").collect()
    assert [(r["lacuna_id"], r["block"]) for r in got] == [(1, 0), (2, 2)]


def test_density_without_tissue_is_zero(spark):
    image = spark.createDataFrame([(1, 0, 1.0), (1, 0, 1.0)], "volume_id int, block int, v double")
    none = spark.createDataFrame([], "volume_id int, block int, voxels bigint")
    cuts = spark.createDataFrame([(1, 0, 1.0)], "volume_id int, block int, threshold double")
    row = morpho.block_density(image, none, cuts, ["volume_id", "block"], 1.0).head()
    assert row["tissue_um3"] == 0 and row["volume_fraction"] == 0 and row["lacunae"] == 0
    blocks = morpho.block_density(image, none, cuts, ["volume_id", "block"], 1.0)
    assert morpho.global_density(blocks, KEYS).count() == 0


def test_sample_ids(spark):
    cases = {
        "a/T1_S26_step0_Z0.nii.gz": "T1_S26_step0_Z0",
        "a/x_original.TIF": "x",
        "a/y_segmented_v2_mask.nii": "y",
        "a/z_lacunae_components.csv": "z_lacunae",
        "dir/_mask.tif": "dir",
        "a/plain.v1.csv": "plain.v1",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", sample_id(F.col("p"))).collect()} == cases


def test_cubes_are_merged_without_broadcasts(spark, monkeypatch, capsys):
    """Files of staged labels are small, their rows are not: no step may go through the driver."""
    def shown(df, name):
        df.explain()
        return stage(df, name)

    monkeypatch.setattr(comp, "stage", shown)
    line = spark.range(0, 12).selectExpr("0L AS k", "id AS z", "0L AS y", "0L AS x")
    found = comp.label_components(line, ["k"], (12, 2, 2), 6, edge=4)
    found.explain()
    assert {r["root"] for r in found.collect()} == {0}
    plans = capsys.readouterr().out
    assert plans.count("SortMergeJoin") >= 4
    assert "Broadcast" not in plans


def test_shape_axes_agree_on_equal_axes(spark, tmp_path):
    """Four voxels of a tetrahedron have equal axes: no span to divide by, on either side."""
    corners = [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)]
    events = [
        (datetime(2024, 1, 5 + 3 * (v % 6) + y, 4 + v % 13 + z), 40 * v + 3 + (7 * v) % 30 + x)
        for v in range(24) for z, y, x in corners
    ]
    spark.createDataFrame(
        [(k, at, user, "view", 1.0) for k, (at, user) in enumerate(events)],
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double",
    ).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in component_plans.shape_axes(spark, str(tmp_path)).collect()}
    assert len(got) == 24 and {r[3:5] for r in got} == {(0.0, 0.0)}
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    assert set(con.execute(component_plans.ORACLES["shape_axes"]).fetchall()) == got
