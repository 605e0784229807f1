"""Volume operators against numpy on small arrays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtrace.operators import histogram as hist
from voxtrace.operators import morphology as morph
from voxtrace.operators import volume as vol
from voxtrace.operators.preprocess import kmeans_intensities, preprocess_slices


def voxels(spark, array, volume=1):
    z, y, x = np.indices(array.shape)
    return spark.createDataFrame(
        pd.DataFrame(
            {"volume_id": volume, "z": z.ravel(), "y": y.ravel(), "x": x.ravel(), "v": array.ravel().astype(float)}
        )
    )


def dense(df, shape, column="v"):
    out = np.zeros(shape)
    for r in df.select("z", "y", "x", column).collect():
        out[r["z"], r["y"], r["x"]] = r[column]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(3).integers(0, 200, (3, 9, 7)).astype(float)


def otsu_numpy(values, bins=256):
    if values.min() == values.max():
        return values.min()
    counts, edges = np.histogram(values, bins)
    centers = (edges[:-1] + edges[1:]) / 2
    w1, w2 = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    m1 = np.cumsum(counts * centers) / np.maximum(w1, 1)
    m2 = (np.cumsum((counts * centers)[::-1]) / np.maximum(np.cumsum(counts[::-1]), 1))[::-1]
    return centers[:-1][np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)]


def gauss_numpy(plane, sigma):
    kernel = np.array(vol.gaussian_kernel(sigma))
    radius = len(kernel) // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius, radius)
        plane = np.apply_along_axis(
            lambda line: np.convolve(line, kernel, "valid"), axis, np.pad(plane, pad, "symmetric")
        )
    return plane


def test_histogram_rules(spark, image):
    df = voxels(spark, image)
    rows = hist.histogram(df, "v", 12).orderBy("bin").collect()
    counts, edges = np.histogram(image, 12)
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r["low_edge"] for r in rows], edges[:-1])
    assert np.isclose(sum(r["frequency"] for r in rows), 1)
    rows = hist.histogram(df, "v", 5, 20, 120).orderBy("bin").collect()
    assert [r["count"] for r in rows] == np.histogram(image, 5, (20, 120))[0].tolist()
    flat = hist.histogram(voxels(spark, np.full((1, 2, 2), 7.0)), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == np.histogram(np.full(4, 7.0), 4)[0].tolist()
    assert flat[0]["low_edge"] == 6.5 and flat[3]["high_edge"] == 7.5
    assert hist.histogram(df, "v", 5000).count() == 5000
    for bad in ((0, None, None), (5, 1.0, None)):
        with pytest.raises(ValueError):
            hist.histogram(df, "v", *bad)


def test_otsu_per_slice(spark, image):
    image = image.copy()
    image[2] = 5
    rows = vol.otsu_slices(voxels(spark, image), "v").orderBy("z").collect()
    assert np.allclose([r["threshold"] for r in rows], [otsu_numpy(p) for p in image])
    assert [r["constant"] for r in rows] == [False, False, True]
    assert [r["retained"] for r in rows] == [int((p > otsu_numpy(p)).sum()) for p in image]
    summary = vol.otsu_volume_summary(vol.otsu_slices(voxels(spark, image), "v")).head()
    assert summary["otsu_threshold"] == 5 and summary["constant_slices"] == 1


def test_bone_volume_threshold_uses_positive_voxels(spark, image):
    image = image.copy()
    image[0] = 0
    row = vol.bone_volume(voxels(spark, image), "v", [2.0, 2.0, 2.0]).head()
    cut = otsu_numpy(image[image > 0])
    assert np.isclose(row["threshold"], cut) and row["n_bone"] == (image > cut).sum()
    assert row["bone_um3"] == row["n_bone"] * 8.0


def test_min_max_constant_and_rounding(spark):
    image = np.array([[[0.0, 1.0], [2.0, 4.0]], [[3.0, 3.0], [3.0, 3.0]]])
    out = dense(vol.min_max_slices(voxels(spark, image), "v", "o", 0, 2, "uint8"), image.shape, "o")
    assert out[0].ravel().tolist() == [0, 0, 1, 2]  # 0.5 rounds to even
    assert (out[1] == 0).all()


def test_gaussian_and_gradient(spark, image):
    df = voxels(spark, image)
    for sigma in (1.0, 2.5):
        got = dense(vol.gaussian_slices(df, "v", "g", sigma, 9, 7), image.shape, "g")
        want = np.stack([gauss_numpy(p, sigma) for p in image])
        assert np.allclose(got, want)
    rows = vol.gradient_magnitude(df, "v").orderBy("z").collect()
    want = [np.hypot(*np.gradient(p)).mean() for p in image]
    assert np.allclose([r["gradient"] for r in rows], want)
    assert {r["z"] for r in vol.central_slices(df).collect()} == {1}
    with pytest.raises(ValueError):
        vol.gaussian_slices(df, "v", "g", 101, 9, 7)


def erode_numpy(mask, offsets):
    out = np.ones_like(mask)
    for dz, dy, dx in offsets:
        moved = np.zeros_like(mask)
        for z, y, x in np.argwhere(mask):
            t = (z - dz, y - dy, x - dx)
            if all(0 <= a < b for a, b in zip(t, mask.shape)):
                moved[t] = True
        out &= moved
    return out


def dilate_numpy(mask, offsets):
    out = np.zeros_like(mask)
    for z, y, x in np.argwhere(mask):
        for dz, dy, dx in offsets:
            t = (z + dz, y + dy, x + dx)
            if all(0 <= a < b for a, b in zip(t, mask.shape)):
                out[t] = True
    return out


@pytest.mark.parametrize("element", [morph.ball(1), morph.ball(2), morph.disk(2), morph.square(2), morph.square(3)])
def test_opening_and_closing(spark, element):
    mask = np.random.default_rng(5).random((4, 8, 9)) < 0.75
    offsets = [(dz, dy, x) for dz, dy, lo, hi in element for x in range(lo, hi + 1)]
    rows = voxels(spark, mask).where("v = 1").drop("v")
    opened = dense(morph.opening(rows, element).withColumn("v", F.lit(1)), mask.shape) > 0
    assert (opened == dilate_numpy(erode_numpy(mask, offsets), offsets)).all()
    assert not (opened & ~mask).any()
    closed = dense(morph.closing(rows, element, mask.shape).withColumn("v", F.lit(1)), mask.shape) > 0
    assert (closed == erode_numpy(dilate_numpy(mask, offsets), offsets)).all()


def test_even_square_reaches_one_place_further_back():
    assert morph.square(20)[0][2:] == (-10, 9) and len(morph.square(20)) == 20
    assert sum(hi - lo + 1 for _, _, lo, hi in morph.disk(25)) == sum(
        x * x + y * y <= 625 for x in range(-25, 26) for y in range(-25, 26)
    )


def test_tiles_cover_like_a_loop(spark):
    height, width, size, overlap = 11, 13, 5, 30
    stride = size - int(size * overlap / 100)
    image = np.arange(height * width, dtype=float).reshape(1, height, width)
    got = (
        vol.overlapping_tiles(voxels(spark, image), height, width, size, overlap)
        .groupBy("tile_row", "tile_col").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    )
    want = {}
    for i, y in enumerate(range(0, height, stride)):
        for j, x in enumerate(range(0, width, stride)):
            y0, x0 = min(y, height - size), min(x, width - size)
            want[i, j] = image[0, y0 : y0 + size, x0 : x0 + size].sum()
    assert {(r["tile_row"], r["tile_col"]): r["s"] for r in got} == want
    assert all(r["n"] == size * size for r in got)
    with pytest.raises(ValueError):
        vol.overlapping_tiles(voxels(spark, image), height, width, 5, 70)


def test_stitching_round_trip(spark, image):
    image = image[:, :, :7]
    tiles = vol.overlapping_tiles(voxels(spark, image), 9, 7, 4, 50)
    assert (dense(vol.stitch(tiles, "v"), image.shape, "stitched") == image).all()
    binary = (image > 100).astype(float)
    tiles = vol.overlapping_tiles(voxels(spark, binary), 9, 7, 4, 50)
    assert (dense(vol.stitch(tiles, "v"), image.shape, "stitched") == binary * 255).all()


def test_z_blocks_follow_a_loop(spark):
    def loop(start, end, size, percent):
        step, z, out = size - int(size * percent / 100), start, []
        while z < end:
            out.append((z, min(z + size, end)))
            if out[-1][1] >= end:
                break
            z += step
        return out

    for args in ((0, 24, 10, 30), (3, 20, 5, 50), (0, 5, 10, 30), (0, 11, 4, 0), (2, 2, 5, 30)):
        assert vol.z_block_bounds(*args) == loop(*args)
    image = np.ones((20, 1, 1))
    rows = vol.z_blocks(voxels(spark, image), 3, 20, 5, 50).groupBy("block").agg(
        F.min("z").alias("a"), F.max("z").alias("b"), F.first("z_start").alias("s"), F.first("z_end").alias("e")
    ).orderBy("block").collect()
    assert [(r["a"], r["b"] + 1) for r in rows] == loop(3, 20, 5, 50) == [(r["s"], r["e"]) for r in rows]
    for bad in ((0, 5, 10, 100), (0, 5, 1, 99.9)):
        try:
            vol.z_block_bounds(*bad)
        except ValueError:
            continue
        assert bad[3] < 100


def test_voxel_size_sources(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0, 3.0], [1.0, 1.0, 1.0], "mm"), (None, [0.1, 0.1, 0.2], "mm"), (None, [1.0, 0.0, 1.0], "mm"),
         (None, [2.0, 2.0, 2.0], None), ([1.0, 2.0], [1.0, 1.0, 1.0], "mm")],
        "u array<double>, h array<double>, unit string",
    )
    sizes, source = vol.voxel_size(F.col("u"), F.col("h"), F.col("unit"), 3)
    got = df.select(F.round(vol.voxel_measure(sizes), 6), source).collect()
    assert [tuple(r) for r in got] == [
        (6.0, "user"), (2e6, "header_mm"), (None, None), (8.0, "header_unknown"), (None, "invalid_user"),
    ]


def imadjust_numpy(plane):
    counts = np.histogram(plane, bins=np.arange(256), range=(0, 255))[0]
    cum = np.cumsum(counts)
    low, high = (np.searchsorted(cum, plane.size * t / 100, side="left") for t in (1, 99))
    out = np.where(plane < low, 0, plane - low) * (255 / (high - low)) + 0.5
    return np.minimum(out, 255)


def test_contrast_stretch(spark):
    plane = np.random.default_rng(9).gamma(2, 30, (1, 40, 40)).clip(0, 255)
    got = dense(hist.contrast_stretch(voxels(spark, plane), vol.SLICE, "v", "s"), plane.shape, "s")
    assert np.allclose(got[0], imadjust_numpy(plane[0]))


def chain_numpy(plane):
    unit = (plane - plane.min()) / (plane.max() - plane.min()) * 255
    adjusted = imadjust_numpy(unit)
    smooth = gauss_numpy(adjusted, 2.0)
    mask = (smooth > otsu_numpy(smooth))[None]
    square = [(0, y, x) for y in range(-10, 10) for x in range(-10, 10)]
    disk = [(0, y, x) for y in range(-25, 26) for x in range(-25, 26) if y * y + x * x <= 625]
    opened = dilate_numpy(erode_numpy(mask, square), square)
    closed = erode_numpy(dilate_numpy(opened, disk), disk)[0]
    return np.where(closed, np.floor(adjusted), 0)


def test_preprocessing_chain(spark):
    rng = np.random.default_rng(11)
    y, x = np.indices((60, 64))
    plane = np.clip((np.hypot(y - 30, x - 32) < 27) * 120 + rng.normal(60, 10, (60, 64)), 0, 255).round()
    got = dense(preprocess_slices(voxels(spark, plane[None]), "v", 60, 64), (1, 60, 64), "masked")[0]
    want = chain_numpy(plane)
    assert (got > 0).any()
    assert (np.abs(got - want) < 1e-9).all()


def test_preprocessing_of_dark_slices_uses_clusters(spark):
    y, x = np.indices((60, 64))
    plane = np.where((y > 15) & (y < 45) & (x > 15) & (x < 45), -50.0, -200.0)
    plane[0, :] = -120.0
    got = dense(preprocess_slices(voxels(spark, plane[None]), "v", 60, 64), (1, 60, 64), "masked")
    assert got.shape == (1, 60, 64)


def test_kmeans_matches_lloyd(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(m, 3, n) for m, n in ((20, 300), (90, 100), (180, 500))]).round()
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": values}))
    rows = kmeans_intensities(df, ["k"], "v").orderBy("cluster").collect()
    centers = values.min() + (np.arange(3) + 0.5) * (values.max() - values.min()) / 3
    for _ in range(100):
        own = np.abs(values[:, None] - centers).argmin(axis=1)
        fresh = np.array([values[own == i].mean() for i in range(3)])
        done = np.abs(fresh - centers).max() <= 0.2
        centers = fresh
        if done:
            break
    assert np.allclose([r["center"] for r in rows], centers)
    assert [r["pixels"] for r in rows] == [300, 100, 500]


def test_decile_signal(spark):
    values = np.arange(1.0, 101)
    row = vol.decile_signal_to_noise(voxels(spark, values.reshape(1, 10, 10)), "v").head()
    low, high = np.percentile(values, [10, 90])
    want = values[values >= high].mean() / values[values <= low].std()
    assert np.isclose(row["snr"], want)


@pytest.mark.parametrize("bins", [2, 16, 256])
def test_real_valued_counts_give_what_lies_above_the_threshold(spark, bins):
    rng = np.random.default_rng(bins)
    groups = {0: rng.normal(0, 1, 3000), 1: rng.normal(5, 3, 40), 2: np.full(9, 1.25), 3: np.array([-2.0, 7.5])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [(4, None), (0, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    counted = hist.split_counts(df, ["k"], "v", bins)
    got = {
        r["k"]: r
        for r in counted.groupBy("k", "threshold", "min", "max")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(hist.above_threshold(), F.col("n")).otherwise(0)).alias("above"),
            F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("positive"),
        )
        .collect()
    }
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        r = got[k]
        assert (r["n"], r["min"], r["max"], r["positive"]) == (len(values), values.min(), values.max(), (values > 0).sum())
        assert r["above"] == (values > r["threshold"]).sum()
        if len(values) > 2:
            assert r["threshold"] == pytest.approx(otsu_numpy(values, bins))
    # a task hands on at most two rows for each bin and sign
    assert hist.binned_counts(df, ["k"], "v", bins).where("k = 0").count() <= 2 * bins + 2


def test_values_that_are_not_eligible_set_no_range(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [-9, -1, 0, 0, 2, 2, 3, 40, 41]], "volume_id long, v double")
    row = vol.bone_volume(df, "v", None).head()
    # the threshold is the centre of the bin of 3, which lies above it
    assert (row["n_total"], row["n_positive"], row["n_bone"]) == (9, 5, 3) and 2 < row["threshold"] < 3
    every = vol.bone_volume(df, "v", None, include_zero=True).head()
    assert every["n_bone"] == sum(v > every["threshold"] for v in [-9, -1, 0, 0, 2, 2, 3, 40, 41])


def test_given_ranges_keep_their_edges_without_values(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    rows = hist.histogram(df, "v", 2, 5.0, 9.0).orderBy("bin").collect()
    assert [tuple(r) for r in rows] == [(0, 5.0, 7.0, 0, 0.0), (1, 7.0, 9.0, 0, 0.0)]
    (row,) = hist.histogram(df, "v", 1, 3.0, 3.0).collect()
    assert tuple(row) == (0, 2.5, 3.5, 0, 0.0)
