"""Slice rows against the voxel operators, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtrace.operators import histogram as hist
from voxtrace.operators import slices as sl
from voxtrace.operators import volume as vol
from voxtrace.session import stage

HEIGHT, WIDTH = 9, 7


@pytest.fixture(scope="module")
def voxels(spark):
    rng = np.random.default_rng(8)
    image = np.round(rng.random((5, HEIGHT, WIDTH)) * 300, 2)
    image[1] = 4.0  # constant
    image[2, :4] = 0.0
    rows = [
        (1 + (z == 4), int(z), int(y), int(x), float(v)) for (z, y, x), v in np.ndenumerate(image)
    ]
    return stage(spark.createDataFrame(rows, "volume_id bigint, z bigint, y bigint, x bigint, v double"), "voxels")


@pytest.fixture(scope="module")
def images(voxels):
    return stage(sl.to_slices(voxels, "v", HEIGHT, WIDTH), "images")


def values(df, column):
    return {(r["volume_id"], r["z"], r["y"], r["x"]): r[column] for r in df.collect()}


def same(slices, column, want, name=None):
    got = values(sl.explode_slices(slices, [column]), column)
    expected = values(want, name or column)
    assert got.keys() == expected.keys() and len(got) == 5 * HEIGHT * WIDTH
    assert [got[k] for k in sorted(got)] == pytest.approx([expected[k] for k in sorted(got)], abs=1e-9)


def test_images_hold_all_voxels(voxels, images):
    same(images, "pixels", voxels, "v")
    (one,) = sl.to_slices(voxels.where("z = 0 AND y = 3 AND x = 2"), "v", HEIGHT, WIDTH, empty=-1.0).collect()
    assert len(one.pixels) == HEIGHT * WIDTH and sum(p == -1 for p in one.pixels) == HEIGHT * WIDTH - 1
    assert sl.to_slices(voxels.where("z > 9"), "v", HEIGHT, WIDTH).count() == 0


@pytest.mark.parametrize(("low", "high", "dtype"), [(0.0, 1.0, "float32"), (0.0, 255.0, "uint8"), (2.0, 5.0, "float32")])
def test_scale(voxels, images, low, high, dtype):
    same(sl.scale(images, "s", low, high, dtype), "s", vol.min_max_slices(voxels, "v", "s", low, high, dtype))
    with pytest.raises(ValueError):
        sl.scale(images, "s", dtype="int7")


@pytest.mark.parametrize("sigma", [0.0, 0.7, 2.0, 9.0])
def test_smooth(voxels, images, sigma):
    same(sl.smooth(images, "g", sigma), "g", vol.gaussian_slices(voxels, "v", "g", sigma, HEIGHT, WIDTH))
    rounded = vol.gaussian_slices(voxels, "v", "g", sigma, HEIGHT, WIDTH, 255)
    same(sl.smooth(images, "g", sigma, 255), "g", rounded)


@pytest.mark.parametrize("mode", ["binary", "masked"])
def test_otsu(voxels, images, mode):
    got = sl.otsu(images, "o", mode, foreground=9.0)
    same(got, "o", vol.apply_otsu(voxels, "v", "o", mode, foreground=9.0))
    columns = ["volume_id", "z", "threshold", "voxels", "retained", "constant", "fraction"]
    want = {(r.volume_id, r.z): r for r in vol.otsu_slices(voxels, "v").select(*columns).collect()}
    for r in got.select(*columns).collect():
        assert tuple(r) == pytest.approx(tuple(want[r.volume_id, r.z]))


def test_gradient_and_stretch(voxels, images):
    want = {(r.volume_id, r.z): r.gradient for r in vol.gradient_magnitude(voxels, "v").collect()}
    got = {(r.volume_id, r.z): r.m for r in sl.gradient(images, "m").collect()}
    assert got == pytest.approx(want)
    same(sl.stretch(images, "t"), "t", hist.contrast_stretch(voxels, vol.SLICE, "v", "t"))


def test_tiles_and_stitching(voxels, images):
    def sums(df, of):
        return {tuple(r)[:-1]: pytest.approx(r[-1]) for r in df.groupBy(*of).agg(F.sum("v")).collect()}

    place = ["volume_id", "z", "tile_row", "tile_col"]
    cut = sl.tile(images, 3).select(*place, F.explode("pixels").alias("v"))
    assert sums(vol.assign_tiles(voxels, HEIGHT, WIDTH, 3), place) == sums(cut, place)
    tiled = sl.tile_overlapping(images, 4, 30)
    whole = [*place, "y0", "x0"]
    assert sums(vol.overlapping_tiles(voxels, HEIGHT, WIDTH, 4, 30), whole) == sums(
        tiled.select(*whole, F.explode("pixels").alias("v")), whole
    )
    want = vol.stitch(vol.overlapping_tiles(voxels, HEIGHT, WIDTH, 4, 30), "v")
    same(sl.stitch_tiles(tiled, HEIGHT, WIDTH), "stitched", want)
    found = sl.tissue(images, 3).select(*place, "tissue").collect()
    expected = vol.tissue_tiles(voxels, "v", HEIGHT, WIDTH, 3).select(*place, "tissue").collect()
    assert {tuple(r)[:-1]: pytest.approx(r[-1]) for r in expected} == {tuple(r)[:-1]: r[-1] for r in found}
    with pytest.raises(ValueError):
        sl.tile_overlapping(images, 4, 80)


def test_missing_pixels_take_no_part(spark):
    rows = [(1, 0, 1, 4, [1.0, None, float("nan"), 3.0]), (1, 1, 1, 2, [None, None])]
    images = spark.createDataFrame(rows, "volume_id long, z long, height long, width long, pixels array<double>")
    first, second = sl.scale(images, "s").orderBy("z").collect()
    assert first.s[0] == 0 and first.s[3] == 1 and all(np.isnan(first.s[1:3]))
    one, none = sl.otsu(images).orderBy("z").collect()
    assert (one.voxels, one.retained) == (2, 1) and (none.voxels, none.retained, none.fraction) == (0, 0, None)


def test_plans_have_no_exchange_after_the_slice_rows(images):
    for df in (
        sl.explode_slices(sl.scale(images, "s"), ["s"]),
        sl.explode_slices(sl.smooth(images, "g", 1.0), ["g"]),
        sl.otsu(images, "o"),
        sl.gradient(images, "m"),
        sl.stretch(images, "t"),
        sl.tile_overlapping(images, 4, 30),
        sl.tissue(images, 3),
    ):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
