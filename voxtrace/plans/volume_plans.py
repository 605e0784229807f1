"""Queries over volume operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrace.functions.rounding import round_columns
from voxtrace.operators import histogram as hist
from voxtrace.operators import morphology as morph
from voxtrace.operators import slices as sl
from voxtrace.operators import volume as vol
from voxtrace.operators.preprocess import kmeans_intensities, preprocess_slices
from voxtrace.plans.views_sql import DENSE, SPARSE
from voxtrace.sources.tables import (
    DENSE_SHAPE,
    IMAGE_SHAPE,
    VOXEL_UM,
    dense_volume,
    quantity_images,
    sparse_grid,
    table,
)

DEPTH, HEIGHT, WIDTH = DENSE_SHAPE


def _slices(spark, sf_dir):
    """One row for each image of the dense volumes."""
    return sl.to_slices(dense_volume(spark, sf_dir), "v", HEIGHT, WIDTH)


def vol_geometry(spark, sf_dir):
    return vol.geometry(sparse_grid(spark, sf_dir))


def bit_depth(spark, sf_dir):
    voxels = sparse_grid(spark, sf_dir).withColumn("v", F.round(F.col("v") * 100))
    return vol.bit_depth(voxels, "v", "float32")


def histogram10(spark, sf_dir):
    rows = hist.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10)
    return round_columns(rows, {"low_edge": 4, "high_edge": 4, "frequency": 6})


def histogram_range(spark, sf_dir):
    rows = hist.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 8, 10.0, 42.0)
    return round_columns(rows, {"low_edge": 4, "high_edge": 4, "frequency": 6})


def intensity_stats(spark, sf_dir):
    rows = vol.intensity_statistics(dense_volume(spark, sf_dir), "v", ["volume_id"])
    return round_columns(rows, {"mean": 6, "std": 6})


def snr(spark, sf_dir):
    rows = vol.decile_signal_to_noise(table(spark, sf_dir, "events"), "value")
    return round_columns(rows, {"signal": 4, "noise": 4, "snr": 4})


def volume_mb(spark, sf_dir):
    return vol.uncompressed_size(vol.geometry(dense_volume(spark, sf_dir)), "uint16")


def flat_slices(spark, sf_dir):
    voxels = sparse_grid(spark, sf_dir).withColumn(
        "v", F.when(F.col("y") == 0, 0.0).otherwise(F.when(F.col("y") == 1, 255.0).otherwise(F.col("v")))
    )
    planes = voxels.select("volume_id", F.col("y").alias("z"), "x", "v")
    return vol.flat_slices(planes, "v", 255.0)


def cohort_dims(spark, sf_dir):
    return vol.cohort_dimensions(vol.geometry(sparse_grid(spark, sf_dir)))


def otsu(spark, sf_dir):
    rows = hist.otsu_threshold(table(spark, sf_dir, "lineitem"), [], "l_extendedprice")
    return round_columns(rows, {"threshold": 4})


def otsu_integer(spark, sf_dir):
    return hist.otsu_threshold(
        table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_quantity", bins=None
    ).select(F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "threshold", "n")


def otsu_slices(spark, sf_dir):
    rows = sl.otsu(_slices(spark, sf_dir)).drop("height", "width", "pixels")
    return round_columns(rows, {"threshold": 6, "fraction": 6})


def otsu_apply(spark, sf_dir):
    named = _slices(spark, sf_dir).withColumnRenamed("pixels", "v")
    binary = sl.otsu(named, "binary", column="v").select(*vol.SLICE, "height", "width", "v", "binary")
    masked = sl.otsu(binary, "masked", mode="masked", column="v")
    return sl.explode_slices(masked, ["v", "binary", "masked"])


def bv_tv(spark, sf_dir):
    rows = vol.otsu_volume_summary(sl.otsu(_slices(spark, sf_dir)))
    return round_columns(rows, {"otsu_threshold": 6, "bv_tv": 6})


def bone_volume(spark, sf_dir):
    rows = vol.bone_volume(dense_volume(spark, sf_dir), "v", [VOXEL_UM] * 3)
    return round_columns(rows, {"threshold": 6, "bone_um3": 4, "bone_mm3": 10})


def voxel_measure(spark, sf_dir):
    size = F.col("p_size").cast("double")
    kind = F.col("p_type")
    header = F.array(size / 10, size / 20, F.when(kind == "PROMO", 0.0).otherwise(size / 40))
    user = F.when(kind == "LARGE", F.array(F.lit(1.5), F.lit(1.5), size)).when(
        kind == "SMALL", F.array(F.lit(1.5), size)
    )
    unit = F.when(kind == "ECONOMY", "mm").when(kind == "MEDIUM", "meter")
    sizes, source = vol.voxel_size(user, header, unit, 3)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(F.log10(vol.voxel_measure(sizes)), 6).alias("log_measure"),
        source.alias("source"),
    )


def minmax_slices(spark, sf_dir):
    named = _slices(spark, sf_dir).withColumnRenamed("pixels", "v")
    scaled = sl.scale(named, "unit", column="v")
    coded = sl.scale(scaled, "code", 0.0, 255.0, "uint8", column="v")
    return round_columns(sl.explode_slices(coded, ["v", "unit", "code"]), {"unit": 6})


def gauss1(spark, sf_dir):
    rows = sl.explode_slices(sl.smooth(_slices(spark, sf_dir), "smooth", 1.0), ["smooth"])
    return round_columns(rows, {"smooth": 5})


def grad_mag(spark, sf_dir):
    """Gradient magnitude of the central slice before and after smoothing."""
    central = sl.to_slices(vol.central_slices(dense_volume(spark, sf_dir)), "v", HEIGHT, WIDTH)
    before = sl.gradient(sl.scale(central, "unit"), "before", column="unit")
    after = sl.gradient(sl.smooth(before, "smooth", 1.0, column="unit"), "after", column="smooth")
    rows = after.select(*vol.SLICE, "before", "after", F.try_divide("after", "before").alias("ratio"))
    return round_columns(rows, {"before": 5, "after": 5, "ratio": 4})


def pct_clip(spark, sf_dir):
    rows = vol.percentile_clip(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.005, 0.995)
    return round_columns(rows, {"lower": 3, "upper": 3, "clipped_mean": 2, "fraction": 6})


def imadjust(spark, sf_dir):
    top = table(spark, sf_dir, "lineitem").agg(F.max("l_extendedprice")).scalar()
    prices = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("line"),
        "l_orderkey",
        "l_partkey",
        F.floor(F.col("l_extendedprice") / top * 255).cast("double").alias("v"),
    )
    rows = hist.contrast_stretch(prices, ["line"], "v", "stretched")
    return rows.groupBy("line", "v", F.round("stretched", 5).alias("stretched")).agg(
        F.count("*").alias("pixels")
    )


def mask_diff(spark, sf_dir):
    voxels = sparse_grid(spark, sf_dir)
    every = voxels.select("volume_id", "z", "y", "x", F.lit(1).alias("label"))
    bright = voxels.where(F.col("v") > 10).select(
        "volume_id", "z", "y", "x", F.when(F.col("v") > 60, 2).otherwise(1).alias("label")
    )
    rows = vol.mask_difference(every, bright, ["volume_id", "z", "y", "x"])
    return round_columns(rows, {"fraction": 6})


def _dense_mask(spark, sf_dir, cut=22):
    return dense_volume(spark, sf_dir).where(F.col("v") > cut).drop("v")


def opening(spark, sf_dir):
    mask = _dense_mask(spark, sf_dir)
    rows = morph.change_summary(mask, morph.opening(mask, morph.ball(1)))
    return round_columns(rows, {"fraction_removed": 6, "fraction_added": 6})


def closing(spark, sf_dir):
    mask = _dense_mask(spark, sf_dir, 25)
    rows = morph.change_summary(mask, morph.closing(mask, morph.ball(1), DENSE_SHAPE))
    return round_columns(rows, {"fraction_removed": 6, "fraction_added": 6})


def tiles(spark, sf_dir):
    return (
        vol.assign_tiles(dense_volume(spark, sf_dir), HEIGHT, WIDTH, 9)
        .groupBy("volume_id", "z", "tile_row", "tile_col")
        .agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))
    )


def tiles_overlap(spark, sf_dir):
    return (
        vol.overlapping_tiles(dense_volume(spark, sf_dir), HEIGHT, WIDTH, 5, 30)
        .groupBy("volume_id", "z", "tile_row", "tile_col", "y0", "x0")
        .agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))
    )


def tissue_tiles(spark, sf_dir):
    rows = sl.tissue(_slices(spark, sf_dir), 28).select(*vol.SLICE, "tile_row", "tile_col", "tissue")
    return round_columns(rows, {"tissue": 6})


def slice_tiles(spark, sf_dir):
    """Tiles cut out of slice rows."""
    return sl.tile(_slices(spark, sf_dir), 9).select(
        *vol.SLICE,
        "tile_row",
        "tile_col",
        F.size("pixels").cast("bigint").alias("pixels"),
        F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


def slice_stitch(spark, sf_dir):
    """Overlapping tiles of slice rows, changed by their place and averaged back."""
    tiled = sl.tile_overlapping(_slices(spark, sf_dir), 5, 30)
    predicted = tiled.withColumn(
        "pixels", F.transform("pixels", lambda v: v * 8 + F.col("tile_row") + F.col("tile_col"))
    )
    return sl.explode_slices(sl.stitch_tiles(predicted, HEIGHT, WIDTH), ["stitched"])


def stitch(spark, sf_dir):
    """Tiles whose values depend on their place are averaged back to pixels."""
    tiled = vol.overlapping_tiles(dense_volume(spark, sf_dir), HEIGHT, WIDTH, 5, 30)
    predicted = tiled.withColumn("p", F.col("v") * 8 + F.col("tile_row") + F.col("tile_col"))
    return vol.stitch(predicted, "p")


def z_blocks(spark, sf_dir):
    return (
        vol.z_blocks(dense_volume(spark, sf_dir), 1, DEPTH, 5, 30)
        .groupBy("volume_id", "block", "z_start", "z_end")
        .agg(F.count("*").alias("voxels"), F.sum("v").alias("total"))
    )


def preprocess_chain(spark, sf_dir):
    return preprocess_slices(quantity_images(spark, sf_dir), "v", *IMAGE_SHAPE)


def kmeans_intensity(spark, sf_dir):
    rows = kmeans_intensities(dense_volume(spark, sf_dir), ["volume_id"], "v")
    return rows.withColumn("center", F.round("center", 4))


QUERIES = {
    f.__name__: f
    for f in (
        vol_geometry, bit_depth, histogram10, histogram_range, intensity_stats, snr, volume_mb,
        flat_slices, cohort_dims, otsu, otsu_integer, otsu_slices, otsu_apply, bv_tv, bone_volume,
        voxel_measure, minmax_slices, gauss1, grad_mag, pct_clip, imadjust, mask_diff, opening,
        closing, tiles, tiles_overlap, tissue_tiles, slice_tiles, slice_stitch, stitch, z_blocks, preprocess_chain,
        kmeans_intensity,
    )
}


def otsu_sql(source: str, keys: list[str], value: str, bins: int | None = 256) -> str:
    """CTEs ending in ``otsu(keys, threshold, lo, hi, total)`` over a named source."""
    by = ", ".join(keys) + (", " if keys else "")
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    join = "USING (" + ", ".join(keys) + ")" if keys else "ON true"
    if bins is None:
        number, centre = f"({value} - lo)::BIGINT", "bin + lo"
    else:
        number = (
            f"CASE WHEN lo = hi THEN 0 ELSE least(floor(({value} - lo) / (hi - lo) * {bins}), "
            f"{bins - 1})::BIGINT END"
        )
        centre = f"lo + (bin + 0.5::DOUBLE) * (hi - lo) / {bins}"
    return f"""otsu_range AS (SELECT {by} min({value}) AS lo, max({value}) AS hi, count(*) AS total
        FROM {source} {group}),
      otsu_bins AS (SELECT {by} lo, hi, total, {number} AS bin, count(*) AS n
        FROM {source} JOIN otsu_range {join} GROUP BY ALL),
      otsu_sums AS (SELECT *,
          (sum(n) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE AS w1,
          (sum(n * bin) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE AS s1,
          (sum(n * bin) OVER ({part}))::DOUBLE AS s
        FROM otsu_bins WINDOW w AS ({part} ORDER BY bin)),
      otsu_var AS (SELECT *, coalesce(w1 * (total - w1)
          * (s1 / w1 - (s - s1) / nullif(total - w1, 0))
          * (s1 / w1 - (s - s1) / nullif(total - w1, 0)), -1) AS spread FROM otsu_sums),
      otsu AS (SELECT {by} CASE WHEN lo = hi THEN lo ELSE {centre} END AS threshold, lo, hi, total
        FROM otsu_var QUALIFY row_number() OVER ({part} ORDER BY spread DESC, bin) = 1)"""


OTSU_SLICES = f"""{DENSE}, {otsu_sql("dense", ["volume_id", "z"], "v")},
  per_slice AS (SELECT volume_id, z, threshold, count(*) AS voxels,
      count(*) FILTER (v > threshold) AS retained, bool_or(lo = hi) AS constant,
      count(*) FILTER (v > threshold) / count(*) AS fraction
    FROM dense JOIN otsu USING (volume_id, z) GROUP BY volume_id, z, threshold)"""


def gauss_sql(
    source: str, value: str, out: str, sigma: float = 1.0, height: int = HEIGHT, width: int = WIDTH
) -> str:
    """CTE chain ``<out>(volume_id, z, y, x, g)``: columns first, then rows."""
    weights = vol.gaussian_kernel(sigma)
    kernel, radius = ", ".join(repr(w) for w in weights), len(weights) // 2

    def mirrored(axis: str, extent: int) -> str:
        place = f"((({axis} + o) % {2 * extent} + {2 * extent}) % {2 * extent})"
        return f"CASE WHEN {place} < {extent} THEN {place} ELSE {2 * extent - 1} - {place} END"

    return f"""{out}_k AS (SELECT unnest([{kernel}]) AS w,
        unnest(range({-radius}, {radius + 1})) AS o),
      {out}_grid AS (SELECT c.*, coalesce(s.v, 0) AS v FROM (
          SELECT volume_id, z, unnest(range({height})) AS y, x FROM (
            SELECT volume_id, z, unnest(range({width})) AS x FROM (
              SELECT DISTINCT volume_id, z FROM {source}))) c
          LEFT JOIN (SELECT volume_id, z, y, x, {value} AS v FROM {source}) s
          USING (volume_id, z, y, x)),
      {out}_v AS (SELECT g.volume_id, g.z, g.y, g.x, sum(w * s.v) AS v FROM
          (SELECT *, {mirrored("y", height)} AS sy FROM {out}_grid, {out}_k) g
          JOIN {out}_grid s ON s.volume_id = g.volume_id AND s.z = g.z AND s.x = g.x AND s.y = g.sy
          GROUP BY ALL),
      {out} AS (SELECT g.volume_id, g.z, g.y, g.x, sum(w * s.v) AS g FROM
          (SELECT *, {mirrored("x", width)} AS sx FROM {out}_v, {out}_k) g
          JOIN {out}_v s ON s.volume_id = g.volume_id AND s.z = g.z AND s.y = g.y AND s.x = g.sx
          GROUP BY ALL)"""


def gradient_sql(source: str, value: str) -> str:
    """SELECT of the mean gradient magnitude per slice."""
    def slope(line: str) -> str:
        before = f"lag({value}) OVER {line}"
        after = f"lead({value}) OVER {line}"
        return f"coalesce(({after} - {before}) / 2, {after} - {value}, {value} - {before}, 0)"

    return f"""SELECT volume_id, z, avg(sqrt(gx * gx + gy * gy)) AS gradient FROM (
        SELECT volume_id, z, {slope("px")} AS gx, {slope("py")} AS gy FROM {source}
        WINDOW px AS (PARTITION BY volume_id, z, y ORDER BY x),
               py AS (PARTITION BY volume_id, z, x ORDER BY y)) GROUP BY volume_id, z"""


def _ball_sql(name: str, mask: str, eroded_first: bool) -> str:
    offsets = "(SELECT unnest([0,0,0,0,0,-1,1]) AS dz, unnest([0,0,0,-1,1,0,0]) AS dy, unnest([0,-1,1,0,0,0,0]) AS dx)"

    def erosion(out: str, source: str) -> str:
        return f"""{out} AS (SELECT volume_id, z - dz AS z, y - dy AS y, x - dx AS x
          FROM {source}, {offsets} GROUP BY ALL HAVING count(*) = 7)"""

    def dilation(out: str, source: str) -> str:
        return f"""{out} AS (SELECT DISTINCT volume_id, z + dz AS z, y + dy AS y, x + dx AS x
          FROM {source}, {offsets}
          WHERE z + dz BETWEEN 0 AND {DEPTH - 1} AND y + dy BETWEEN 0 AND {HEIGHT - 1}
            AND x + dx BETWEEN 0 AND {WIDTH - 1})"""

    if eroded_first:
        return f"{erosion(name + '_1', mask)}, {dilation(name, name + '_1')}"
    return f"{dilation(name + '_1', mask)}, {erosion(name, name + '_1')}"


def _change_sql(before: str, after: str) -> str:
    return f"""SELECT volume_id, count(b) AS voxels_before, count(a) AS voxels_after,
        count(*) FILTER (a IS NULL) AS voxels_removed, count(*) FILTER (b IS NULL) AS voxels_added,
        round(count(*) FILTER (a IS NULL) / count(b), 6) AS fraction_removed,
        round(count(*) FILTER (b IS NULL) / count(b), 6) AS fraction_added
      FROM (SELECT volume_id, z, y, x, 1 AS b FROM {before})
      FULL JOIN (SELECT volume_id, z, y, x, 1 AS a FROM {after}) USING (volume_id, z, y, x)
      GROUP BY volume_id"""


def _histogram_sql(bins: int, value: str, lo: str, hi: str) -> str:
    return f"""r AS (SELECT {lo} AS lo, {hi} AS hi FROM lineitem),
      h AS (SELECT least(floor(({value} - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT AS bin,
          count(*) AS n FROM lineitem, r WHERE {value} BETWEEN lo AND hi GROUP BY bin)
      SELECT b.bin, round(lo + b.bin * ((hi - lo) / {bins}), 4) AS low_edge,
        round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 4) AS high_edge, coalesce(n, 0) AS count,
        round(coalesce(n, 0) / (SELECT sum(n) FROM h), 6) AS frequency
      FROM (SELECT unnest(range({bins})) AS bin) b LEFT JOIN h USING (bin), r"""


def _line_step(out: str, source: str, axis: str, grow: bool) -> str:
    """Dilation or erosion of a mask by twenty places along one axis, offsets -10..9."""
    other = "y" if axis == "x" else "x"
    extent = IMAGE_SHAPE[1] if axis == "x" else IMAGE_SHAPE[0]
    offsets = "(SELECT unnest(range(-10, 10)) AS o)"
    if grow:
        return f"""{out} AS (SELECT DISTINCT volume_id, z, {other}, {axis} + o AS {axis} FROM {source}, {offsets}
          WHERE {axis} + o BETWEEN 0 AND {extent - 1})"""
    return f"""{out} AS (SELECT volume_id, z, {other}, {axis} - o AS {axis} FROM {source}, {offsets}
      GROUP BY ALL HAVING count(*) = 20)"""


CHAIN = f"""cells AS (SELECT l_suppkey // 50 AS volume_id,
    (CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END)::BIGINT AS z,
    ((l_quantity - 1) * 2 + CASE WHEN round(l_discount * 100) > 5 THEN 1 ELSE 0 END)::BIGINT AS y,
    ((dayofyear(l_shipdate) - 1) // 4)::BIGINT AS x,
    round(sum(l_quantity * (100 - round(l_discount * 100))) / count(*)) AS v FROM lineitem GROUP BY ALL),
  image AS (SELECT g.*, coalesce(v, 0) AS v FROM (SELECT volume_id, z, y, unnest(range({IMAGE_SHAPE[1]})) AS x FROM (
      SELECT volume_id, z, unnest(range({IMAGE_SHAPE[0]})) AS y FROM (SELECT DISTINCT volume_id, z FROM cells))) g
    LEFT JOIN cells USING (volume_id, z, y, x)),
  unit AS (SELECT *, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255 AS u FROM image
    WINDOW w AS (PARTITION BY volume_id, z)),
  bins AS (SELECT volume_id, z, least(floor(u), 254)::BIGINT AS bin, count(*) AS n FROM unit GROUP BY ALL),
  cums AS (SELECT *, sum(n) OVER (PARTITION BY volume_id, z ORDER BY bin) AS cum,
    sum(n) OVER (PARTITION BY volume_id, z) AS total FROM bins),
  limits AS (SELECT volume_id, z, (min(bin) FILTER (cum >= total * 1 / 100))::DOUBLE AS lim_lo,
    (min(bin) FILTER (cum >= total * 99 / 100))::DOUBLE AS lim_hi FROM cums GROUP BY ALL),
  adjusted AS (SELECT volume_id, z, y, x, least(CASE WHEN u < lim_lo THEN 0 ELSE u - lim_lo END
    * (255.0::DOUBLE / (lim_hi - lim_lo)) + 0.5::DOUBLE, 255) AS a FROM unit JOIN limits USING (volume_id, z)),
  {gauss_sql("adjusted", "a", "soft", 2.0, *IMAGE_SHAPE)},
  {otsu_sql("soft", ["volume_id", "z"], "g")},
  mask AS (SELECT volume_id, z, y, x FROM soft JOIN otsu USING (volume_id, z) WHERE g > threshold),
  {_line_step("m1", "mask", "x", False)}, {_line_step("m2", "m1", "y", False)},
  {_line_step("m3", "m2", "x", True)}, {_line_step("m4", "m3", "y", True)},
  disk AS (SELECT dy, dx FROM (SELECT unnest(range(-25, 26)) AS dy), (SELECT unnest(range(-25, 26)) AS dx)
    WHERE dy * dy + dx * dx <= 625),
  grown AS (SELECT DISTINCT volume_id, z, y + dy AS y, x + dx AS x FROM m4, disk
    WHERE y + dy BETWEEN 0 AND {IMAGE_SHAPE[0] - 1} AND x + dx BETWEEN 0 AND {IMAGE_SHAPE[1] - 1}),
  closed AS (SELECT volume_id, z, y - dy AS y, x - dx AS x, 1 AS inside FROM grown, disk GROUP BY ALL
    HAVING count(*) = (SELECT count(*) FROM disk))"""


TILED = f"""{DENSE}, ty AS (SELECT row_number() OVER () - 1 AS tile_row, least(s, {HEIGHT - 5}) AS y0
    FROM (SELECT unnest(range(0, {HEIGHT}, 4)) AS s ORDER BY s)),
  tx AS (SELECT row_number() OVER () - 1 AS tile_col, least(s, {WIDTH - 5}) AS x0
    FROM (SELECT unnest(range(0, {WIDTH}, 4)) AS s ORDER BY s)),
  tiled AS (SELECT * FROM dense JOIN ty ON y >= y0 AND y < y0 + 5 JOIN tx ON x >= x0 AND x < x0 + 5)"""

ORACLES = {
    "vol_geometry": f"""WITH {SPARSE} SELECT volume_id, max(z) + 1 AS n_slices, max(y) + 1 AS height,
      max(x) + 1 AS width FROM sparse GROUP BY volume_id""",
    "bit_depth": f"""WITH {SPARSE}, r AS (SELECT volume_id, max(round(v * 100)) - min(round(v * 100)) AS d
        FROM sparse WHERE z = 0 GROUP BY volume_id)
      SELECT volume_id, d AS dynamic_range,
        (CASE WHEN d <= 255 THEN 8 WHEN d <= 4095 THEN 12 ELSE 16 END)::BIGINT AS bit_depth FROM r""",
    "histogram10": "WITH "
    + _histogram_sql(10, "l_extendedprice", "min(l_extendedprice)", "max(l_extendedprice)"),
    "histogram_range": "WITH "
    + _histogram_sql(8, "l_quantity", "max(10.0::DOUBLE)", "max(42.0::DOUBLE)"),
    "intensity_stats": f"""WITH {DENSE} SELECT volume_id, count(*) AS voxels, min(v) AS min, max(v) AS max,
      round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM dense GROUP BY volume_id""",
    "snr": """WITH c AS (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events),
      s AS (SELECT avg(value) FILTER (value >= hi) AS signal,
        stddev_pop(value) FILTER (value <= lo) AS noise FROM events, c)
      SELECT round(signal, 4) AS signal, round(noise, 4) AS noise, round(signal / noise, 4) AS snr FROM s""",
    "volume_mb": f"""WITH {DENSE} SELECT volume_id,
      round((max(z) + 1) * (max(y) + 1) * (max(x) + 1) * 2 / 1e6::DOUBLE, 2) AS megabytes
      FROM dense GROUP BY volume_id""",
    "flat_slices": f"""WITH {SPARSE}, p AS (SELECT volume_id, y AS z,
        CASE y WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE v END AS v FROM sparse),
      m AS (SELECT volume_id, z, min(v) AS lo, max(v) AS hi FROM p GROUP BY ALL)
      SELECT volume_id, z, CASE WHEN hi = 0 THEN 'black' ELSE 'white' END AS kind
      FROM m WHERE hi = 0 OR lo = 255""",
    "cohort_dims": f"""WITH {SPARSE}, g AS (SELECT volume_id, max(y) + 1 AS height, max(x) + 1 AS width
        FROM sparse GROUP BY volume_id)
      SELECT *, (SELECT count(*) FROM g) AS n_samples,
        (SELECT count(DISTINCT (height, width)) = 1 FROM g) AS all_same FROM g""",
    "otsu": f"""WITH {otsu_sql("lineitem", [], "l_extendedprice")}
      SELECT round(threshold, 4) AS threshold, lo AS min, hi AS max, total AS n FROM otsu""",
    "otsu_integer": f"""WITH {otsu_sql("lineitem", ["l_linenumber"], "l_quantity", None)}
      SELECT l_linenumber::BIGINT AS l_linenumber, threshold, total AS n FROM otsu""",
    "otsu_slices": f"""WITH {OTSU_SLICES} SELECT volume_id, z, round(threshold, 6) AS threshold, voxels,
      retained, constant, round(fraction, 6) AS fraction FROM per_slice""",
    "otsu_apply": f"""WITH {DENSE}, {otsu_sql("dense", ["volume_id", "z"], "v")}
      SELECT volume_id, z, y, x, v, CASE WHEN v > threshold THEN 1.0::DOUBLE ELSE 0 END AS "binary",
        CASE WHEN v > threshold THEN v ELSE 0 END AS masked FROM dense JOIN otsu USING (volume_id, z)""",
    "bv_tv": f"""WITH {OTSU_SLICES} SELECT volume_id, round(arg_max(threshold, z), 6) AS otsu_threshold,
      sum(retained)::BIGINT AS retained, sum(voxels)::BIGINT AS voxels,
      round(sum(retained) / sum(voxels), 6) AS bv_tv,
      count(*) FILTER (constant) AS constant_slices FROM per_slice GROUP BY volume_id""",
    "bone_volume": f"""WITH {DENSE}, positive AS (SELECT * FROM dense WHERE v > 0),
      {otsu_sql("positive", ["volume_id"], "v")},
      b AS (SELECT volume_id, threshold, count(*) AS n_total, count(*) FILTER (v > 0) AS n_positive,
        count(*) FILTER (v > threshold) AS n_bone FROM dense JOIN otsu USING (volume_id)
        GROUP BY volume_id, threshold)
      SELECT volume_id, round(threshold, 6) AS threshold, n_total, n_positive, n_bone,
        round(n_bone * {VOXEL_UM**3!r}::DOUBLE, 4) AS bone_um3,
        round(n_bone * {VOXEL_UM**3!r}::DOUBLE / 1e9::DOUBLE, 10) AS bone_mm3 FROM b""",
    "voxel_measure": """WITH p AS (SELECT p_partkey, p_type, p_size::DOUBLE AS s,
        CASE p_type WHEN 'ECONOMY' THEN 1e3::DOUBLE WHEN 'MEDIUM' THEN 1e6::DOUBLE ELSE 1 END AS k FROM part)
      SELECT p_partkey, round(log10(CASE WHEN p_type = 'LARGE' THEN 1.5::DOUBLE * 1.5::DOUBLE * s
          WHEN p_type IN ('SMALL', 'PROMO') THEN NULL
          ELSE list_product([s / 10 * k, s / 20 * k, s / 40 * k]) END), 6) AS log_measure,
        CASE p_type WHEN 'LARGE' THEN 'user' WHEN 'SMALL' THEN 'invalid_user' WHEN 'PROMO' THEN NULL
          WHEN 'ECONOMY' THEN 'header_mm' WHEN 'MEDIUM' THEN 'header_meter'
          ELSE 'header_unknown' END AS source FROM p""",
    "minmax_slices": f"""WITH {DENSE}, r AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi
        FROM dense WINDOW w AS (PARTITION BY volume_id, z))
      SELECT volume_id, z, y, x, v, round(coalesce((v - lo) / nullif(hi - lo, 0), 0), 6) AS unit,
        round_even(coalesce((v - lo) / nullif(hi - lo, 0) * 255, 0), 0) AS code FROM r""",
    "gauss1": f"""WITH {DENSE}, {gauss_sql("dense", "v", "smoothed")}
      SELECT volume_id, z, y, x, round(g, 5) AS smooth FROM smoothed""",
    "grad_mag": f"""WITH {DENSE}, mid AS (SELECT volume_id, (max(z) + 1) // 2 AS z FROM dense GROUP BY volume_id),
      scaled AS (SELECT volume_id, z, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS u
        FROM dense SEMI JOIN mid USING (volume_id, z) WINDOW w AS (PARTITION BY volume_id, z)),
      {gauss_sql("scaled", "u", "smoothed")},
      b AS ({gradient_sql("scaled", "u")}), a AS ({gradient_sql("smoothed", "g")})
      SELECT volume_id, z, round(b.gradient, 5) AS before, round(a.gradient, 5) AS after,
        round(a.gradient / b.gradient, 4) AS ratio FROM b JOIN a USING (volume_id, z)""",
    "pct_clip": """WITH c AS (SELECT quantile_cont(l_extendedprice, 0.005) AS lo,
        quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem)
      SELECT round(max(lo), 3) AS lower, round(max(hi), 3) AS upper,
        count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi) AS clipped, count(*) AS voxels,
        round(avg(least(greatest(l_extendedprice, lo), hi)), 2) AS clipped_mean,
        round(count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi) / count(*), 6) AS fraction
      FROM lineitem, c""",
    "imadjust": """WITH p AS (SELECT l_linenumber::BIGINT AS line,
        floor(l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) * 255) AS v FROM lineitem),
      b AS (SELECT line, least(v, 254)::BIGINT AS bin, count(*) AS n FROM p GROUP BY ALL),
      c AS (SELECT *, sum(n) OVER (PARTITION BY line ORDER BY bin) AS cum,
        sum(n) OVER (PARTITION BY line) AS total FROM b),
      lim AS (SELECT line, (min(bin) FILTER (cum >= total * 1 / 100))::DOUBLE AS lo,
        (min(bin) FILTER (cum >= total * 99 / 100))::DOUBLE AS hi FROM c GROUP BY line)
      SELECT line, v, round(least(CASE WHEN v < lo THEN 0 ELSE v - lo END
          * (255.0::DOUBLE / (hi - lo)) + 0.5::DOUBLE, 255), 5) AS stretched, count(*) AS pixels
      FROM p JOIN lim USING (line) GROUP BY ALL""",
    "mask_diff": f"""WITH {SPARSE}, b AS (SELECT volume_id, z, y, x, CASE WHEN v > 60 THEN 2 ELSE 1 END AS r
        FROM sparse WHERE v > 10)
      SELECT volume_id, count(*) AS compared, count(*) FILTER (r IS DISTINCT FROM 1) AS differing,
        count(*) FILTER (r IS DISTINCT FROM 1) = 0 AS identical,
        round(count(*) FILTER (r IS DISTINCT FROM 1) / count(*), 6) AS fraction
      FROM sparse FULL JOIN b USING (volume_id, z, y, x) GROUP BY volume_id""",
    "opening": f"""WITH {DENSE}, mask AS (SELECT volume_id, z, y, x FROM dense WHERE v > 22),
      {_ball_sql("opened", "mask", True)} {_change_sql("mask", "opened")}""",
    "closing": f"""WITH {DENSE}, mask AS (SELECT volume_id, z, y, x FROM dense WHERE v > 25),
      {_ball_sql("closed", "mask", False)} {_change_sql("mask", "closed")}""",
    "tiles": f"""WITH {DENSE} SELECT volume_id, z, y // 3 AS tile_row, x // 3 AS tile_col,
      count(*) AS pixels, sum(v) AS total FROM dense WHERE y // 3 < 10 AND x // 3 < 2 GROUP BY ALL""",
    "tiles_overlap": f"""WITH {TILED} SELECT volume_id, z, tile_row, tile_col, y0, x0, count(*) AS pixels,
      sum(v) AS total FROM tiled GROUP BY ALL""",
    "tissue_tiles": f"""WITH {DENSE}, {otsu_sql("dense", ["volume_id", "z"], "v")}
      SELECT volume_id, z, y AS tile_row, x AS tile_col, round(avg((v > threshold)::INTEGER), 6) AS tissue
      FROM dense JOIN otsu USING (volume_id, z) GROUP BY ALL HAVING tissue > 0""",
    "stitch": f"""WITH {TILED}, m AS (SELECT volume_id, z, y, x,
        floor(sum(v * 8 + tile_row + tile_col) / count(*)) AS s FROM tiled GROUP BY ALL)
      SELECT volume_id, z, y, x, (CASE WHEN max(s) OVER (PARTITION BY volume_id, z) > 1
        THEN least(s, 255) ELSE s * 255 END)::BIGINT AS stitched FROM m""",
    "preprocess_chain": f"""WITH {CHAIN} SELECT volume_id, z, y, x,
      (CASE WHEN inside = 1 THEN floor(a) ELSE 0 END)::BIGINT AS masked
      FROM adjusted LEFT JOIN closed USING (volume_id, z, y, x)""",
    "kmeans_intensity": f"""WITH RECURSIVE {DENSE}, lloyd AS (
        SELECT volume_id, 0 AS turn, 1e9::DOUBLE AS shift, min(v) + 0.5::DOUBLE * (max(v) - min(v)) / 3 AS c0,
          min(v) + 1.5::DOUBLE * (max(v) - min(v)) / 3 AS c1, min(v) + 2.5::DOUBLE * (max(v) - min(v)) / 3 AS c2
        FROM dense GROUP BY volume_id
        UNION ALL SELECT volume_id, turn + 1, greatest(abs(n0 - c0), abs(n1 - c1), abs(n2 - c2)), n0, n1, n2 FROM (
          SELECT l.volume_id, l.turn, l.c0, l.c1, l.c2,
            coalesce(avg(v) FILTER (abs(v - c0) <= least(abs(v - c1), abs(v - c2))), c0) AS n0,
            coalesce(avg(v) FILTER (abs(v - c1) < abs(v - c0) AND abs(v - c1) <= abs(v - c2)), c1) AS n1,
            coalesce(avg(v) FILTER (abs(v - c2) < least(abs(v - c0), abs(v - c1))), c2) AS n2
          FROM lloyd l JOIN dense USING (volume_id) WHERE shift > 0.2::DOUBLE AND turn < 100
          GROUP BY l.volume_id, l.turn, l.c0, l.c1, l.c2)),
      best AS (SELECT * FROM lloyd QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY turn DESC) = 1),
      own AS (SELECT volume_id, c0, c1, c2, CASE WHEN abs(v - c0) <= least(abs(v - c1), abs(v - c2)) THEN 0
        WHEN abs(v - c1) <= abs(v - c2) THEN 1 ELSE 2 END AS cluster FROM dense JOIN best USING (volume_id)),
      centers AS (SELECT volume_id, unnest([0, 1, 2]) AS cluster, unnest([c0, c1, c2]) AS center FROM best)
      SELECT volume_id, cluster, round(center, 4) AS center, count(own.cluster) AS pixels
      FROM centers LEFT JOIN own USING (volume_id, cluster) GROUP BY volume_id, cluster, center""",
    "z_blocks": f"""WITH {DENSE}, b AS (SELECT unnest([0, 1, 2]::BIGINT[]) AS block,
        unnest([1, 5, 9]::BIGINT[]) AS z_start, unnest([6, 10, 12]::BIGINT[]) AS z_end)
      SELECT volume_id, block, z_start, z_end, count(*) AS voxels, sum(v) AS total
      FROM dense JOIN b ON z >= z_start AND z < z_end GROUP BY ALL""",
}

# the same results from slice rows
ORACLES["slice_tiles"] = ORACLES["tiles"]
ORACLES["slice_stitch"] = ORACLES["stitch"]
