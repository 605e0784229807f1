"""Queries over connected components and morphometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrace.functions import text
from voxtrace.functions.rounding import round_columns
from voxtrace.operators import components as comp
from voxtrace.operators import morphometry as morpho
from voxtrace.operators import mesh
from voxtrace.operators import morphology as morph
from voxtrace.operators import volume as vol
from voxtrace.operators.audit import seven_number_summary
from voxtrace.operators.histogram import otsu_threshold
from voxtrace.plans.views_sql import DENSE, SPARSE
from voxtrace.plans.volume_plans import otsu_sql
from voxtrace.session import stage, staging_path
from voxtrace.sources.csv_table import read_csv_table
from voxtrace.sources.tables import (
    DENSE_SHAPE,
    SPARSE_SHAPE,
    VOXEL_UM,
    dense_volume,
    sparse_grid,
    table,
)

CELL = VOXEL_UM**3
VOLUME = ["volume_id"]
BLOCK = ["volume_id", "block"]


def _mask(spark, sf_dir):
    return sparse_grid(spark, sf_dir).select("volume_id", "z", "y", "x", "label")


def _labelled(spark, sf_dir, connectivity=6, keys=VOLUME):
    return comp.label_components(_mask(spark, sf_dir), keys, SPARSE_SHAPE, connectivity)


def components6(spark, sf_dir):
    return _labelled(spark, sf_dir).select("volume_id", "voxel", "root")


def components26(spark, sf_dir):
    """Labels from cubes of sixteen voxels that have to be merged across their faces."""
    return comp.label_components(
        _mask(spark, sf_dir), VOLUME, SPARSE_SHAPE, 26, edge=16
    ).select("volume_id", "voxel", "root")


def components_2d(spark, sf_dir):
    """Four-connected components of every slice."""
    return comp.label_components(
        _mask(spark, sf_dir), ["volume_id", "z"], SPARSE_SHAPE, 4, dimensions=2
    ).select("volume_id", "voxel", "root")


def component_sizes(spark, sf_dir):
    sizes = comp.component_sizes(_labelled(spark, sf_dir), VOLUME)
    return comp.component_table(sizes, VOLUME, CELL, minimum=3, maximum=8).select(
        "volume_id", "component_id", "voxel_count", F.round("volume_um3", 4).alias("volume_um3")
    )


def component_csv(spark, sf_dir):
    """Component table written as CSV and read back."""
    sizes = comp.component_sizes(_labelled(spark, sf_dir, 18), VOLUME)
    path = staging_path(spark, "components") + ".csv"
    rows = comp.component_table(sizes, VOLUME, CELL, minimum=2)
    rows.write.csv(path, header=True)
    back = read_csv_table(spark, path)
    return back.withColumn("volume_um3", F.round("volume_um3", 4))


def component_totals(spark, sf_dir):
    sizes = comp.component_sizes(_labelled(spark, sf_dir), VOLUME)
    return round_columns(
        comp.component_totals(sizes, VOLUME, CELL, minimum=2, maximum=6), {"total_um3": 4}
    )


def class_components(spark, sf_dir):
    keys = ["volume_id", "label"]
    sizes = comp.component_sizes(_labelled(spark, sf_dir, 26, keys), keys)
    name = F.when(F.col("label") == 1, "lacunae").otherwise("cracks")
    return sizes.groupBy("volume_id", name.alias("class_name")).agg(
        F.count("*").alias("components"), F.sum("voxels").alias("voxels")
    )


def paired_component_counts(spark, sf_dir):
    """Component counts of the mask before and after a closing, with their difference."""
    mask = _mask(spark, sf_dir).drop("label")
    closed = morph.closing(mask, morph.ball(1), SPARSE_SHAPE)
    sides = mask.withColumn("side", F.lit("a")).unionByName(closed.withColumn("side", F.lit("b")))
    keys = ["volume_id", "side"]
    sizes = comp.component_sizes(
        comp.label_components(sides, keys, SPARSE_SHAPE, 6), keys
    )
    counts = sizes.groupBy("volume_id").agg(
        F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b")
    )
    return counts.withColumn("b_has_fewer", F.col("n_b") < F.col("n_a")).withColumn(
        "difference", F.col("n_a") - F.col("n_b")
    )


def clear_border(spark, sf_dir):
    cleared = comp.clear_border(_labelled(spark, sf_dir), VOLUME, SPARSE_SHAPE)
    return cleared.select("volume_id", "voxel", "root")


def sample_id(spark, sf_dir):
    kind = F.col("p_type")
    name = F.regexp_replace("p_name", " ", ".")
    suffix = (
        F.when(kind == "SMALL", "_original.nii.gz")
        .when(kind == "LARGE", "_segmented_v2_mask.tif")
        .when(kind == "PROMO", "_lacunae_components.CSV")
        .when(kind == "ECONOMY", "_mask.TIFF")
        .otherwise("")
    )
    path = F.concat(F.lit("a/"), F.col("p_brand"), F.lit("/"), name, suffix)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.sample_id(path).alias("sample_id")
    )


def _lacunae(spark, sf_dir):
    """Small-band lacunae away from the border, 18-connected."""
    labelled = comp.clear_border(_labelled(spark, sf_dir, 18), VOLUME, SPARSE_SHAPE)
    return morpho.select_lacunae(labelled, VOLUME, 3, morpho.LACUNA_MAX)


def lacuna_moments(spark, sf_dir):
    rows = morpho.lacuna_moments(_lacunae(spark, sf_dir), VOLUME, VOXEL_UM)
    return round_columns(
        rows, {**{f"centroid_{a}": 6 for a in "xyz"}, **{f"bbox_{a}_um": 6 for a in "xyz"}}
    )


def lacuna_band(spark, sf_dir):
    """Components of 58 to 899 voxels with 26-connectivity."""
    labelled = _labelled(spark, sf_dir, 26)
    sizes = comp.component_sizes(morpho.select_lacunae(labelled, VOLUME), VOLUME)
    return comp.number_components(sizes, VOLUME)


def shape_features(spark, sf_dir):
    rows = morpho.shape_features(_lacunae(spark, sf_dir), VOLUME, VOXEL_UM)
    return round_columns(
        rows, {c: 6 for c, t in rows.dtypes if t == "double"}
    )


def shape_axes(spark, sf_dir):
    """Shape features that do not depend on the sign of an axis."""
    rows = morpho.shape_features(_lacunae(spark, sf_dir), VOLUME, VOXEL_UM)
    names = ["stretch", "oblateness", "major_um", "minor_um", "axis_ratio"]
    return rows.select("volume_id", "root", "voxels", *[F.round(n, 4).alias(n) for n in names])


def exposed_faces(spark, sf_dir):
    rows = morpho.surface_measures(_lacunae(spark, sf_dir), VOLUME, VOXEL_UM)
    return round_columns(rows, {"surface_um2": 6, "ratio_raw": 6, "ratio_um": 6})


MESH_DIGITS = {
    "mesh_area": 6, "mesh_volume": 6, "mesh_area_um2": 6, "mesh_volume_um3": 6, "mesh_ratio_raw": 6,
    "mesh_ratio_um": 6,
}


def mesh_surface(spark, sf_dir):
    """Mesh area, mesh volume and their ratios of every lacuna."""
    return round_columns(mesh.mesh_measures(_lacunae(spark, sf_dir), VOLUME, VOXEL_UM), MESH_DIGITS)


def _blocks(spark, sf_dir):
    voxels = sparse_grid(spark, sf_dir).select("volume_id", "z", "y", "x", "v")
    return vol.z_blocks(voxels, 0, SPARSE_SHAPE[0], 10, 30).drop("z_start", "z_end")


def _block_lacunae(spark, sf_dir):
    labelled = comp.label_components(
        _blocks(spark, sf_dir), BLOCK, SPARSE_SHAPE, morpho.LACUNA_CONNECTIVITY
    )
    kept = morpho.select_lacunae(labelled, BLOCK, 2, morpho.LACUNA_MAX)
    return morpho.lacuna_moments(kept, BLOCK, VOXEL_UM)


def dedupe_centroids(spark, sf_dir):
    rows = morpho.deduplicate_lacunae(
        _block_lacunae(spark, sf_dir), VOLUME, ["block", "root"]
    )
    return rows.select(
        "volume_id", "lacuna_id", "block", "root", "voxels",
        *[F.round(f"centroid_{a}", 6).alias(f"centroid_{a}") for a in "xyz"],
    )


def _density(spark, sf_dir, legacy_units=False):
    """Blocks of the dense volume; components above 30 stand for lacunae."""
    image = vol.z_blocks(dense_volume(spark, sf_dir), 0, DENSE_SHAPE[0], 5, 30).drop(
        "z_start", "z_end"
    )
    labelled = comp.label_components(
        image.where(F.col("v") > 30), BLOCK, DENSE_SHAPE, morpho.LACUNA_CONNECTIVITY
    )
    sizes = comp.component_sizes(labelled, BLOCK)
    thresholds = otsu_threshold(image, BLOCK, "v")
    return morpho.block_density(image, sizes, thresholds, BLOCK, VOXEL_UM, legacy_units)


DENSITY_DIGITS = {
    "lacunar_um3": 4, "background_um3": 4, "tissue_um3": 4, "lacunae_per_tissue": 8,
    "volume_fraction": 8,
}


def block_density(spark, sf_dir):
    return round_columns(_density(spark, sf_dir), DENSITY_DIGITS)


def block_density_legacy(spark, sf_dir):
    return round_columns(_density(spark, sf_dir, legacy_units=True), DENSITY_DIGITS)


def global_density(spark, sf_dir):
    rows = morpho.global_density(_density(spark, sf_dir), VOLUME)
    return round_columns(rows, {"lacunar_um3": 3, "tissue_um3": 3, "density": 8})


def lacuna_summary(spark, sf_dir):
    """Seven-number summary of the lacuna measures over all volumes."""
    faces = morpho.surface_measures(_lacunae(spark, sf_dir), VOLUME, VOXEL_UM)
    rows = seven_number_summary(
        stage(faces.select(F.col("voxels").cast("double").alias("volume"), "surface_um2"), "faces"),
        ["volume", "surface_um2"],
    )
    return round_columns(rows, {c: 4 for c, t in rows.dtypes if t == "double"})


QUERIES = {
    f.__name__: f
    for f in (
        components6, components26, components_2d, component_sizes, component_csv,
        component_totals, class_components, paired_component_counts, clear_border, sample_id,
        lacuna_moments, lacuna_band, shape_features, shape_axes, exposed_faces, mesh_surface, dedupe_centroids,
        block_density, block_density_legacy, global_density, lacuna_summary,
    )
}


def labels_sql(
    source: str, keys: str, connectivity: int, shape: tuple[int, int, int], dimensions: int = 3
) -> str:
    """CTEs ending in ``lab(keys, z, y, x, voxel, root)`` by repeated minimum labels."""
    offsets = comp.neighbour_offsets(dimensions, connectivity)
    dz, dy, dx = (", ".join(str(o[i]) for o in offsets) for i in range(3))
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    keyed = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""vox AS MATERIALIZED (SELECT *, (z * {shape[1]} + y) * {shape[2]} + x AS voxel FROM {source}),
      offs AS (SELECT unnest([{dz}]) AS dz, unnest([{dy}]) AS dy, unnest([{dx}]) AS dx),
      nb AS MATERIALIZED (SELECT {keyed}, a.voxel AS va, b.voxel AS vb FROM (SELECT * FROM vox, offs) a
        JOIN vox b ON {on} AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
      reach({keys}, voxel, root) USING KEY ({keys}, voxel) AS (
        SELECT {keys}, voxel, voxel FROM vox
        UNION SELECT {keyed}, nb.vb, min(a.root) FROM reach a
          JOIN nb ON {on.replace("b.", "nb.")} AND nb.va = a.voxel
          JOIN recurring.reach r ON {on.replace("b.", "r.")} AND r.voxel = nb.vb
          WHERE a.root < r.root GROUP BY ALL),
      tops AS (SELECT * FROM reach),
      lab AS (SELECT vox.*, root FROM vox JOIN tops USING ({keys}, voxel))"""


def _near_border(shape) -> str:
    return " OR ".join(
        f"{a} < 2 OR {a} >= {e - 2}" for a, e in zip("zyx", shape)
    )


LABELS6 = f"RECURSIVE {SPARSE}, {labels_sql('sparse', 'volume_id', 6, SPARSE_SHAPE)}"
LABELS18 = f"RECURSIVE {SPARSE}, {labels_sql('sparse', 'volume_id', 18, SPARSE_SHAPE)}"
LABELS26 = f"RECURSIVE {SPARSE}, {labels_sql('sparse', 'volume_id', 26, SPARSE_SHAPE)}"
LACUNAE = f"""{LABELS18}, cleared AS (SELECT * FROM lab ANTI JOIN (SELECT DISTINCT volume_id, root FROM lab
    WHERE {_near_border(SPARSE_SHAPE)}) USING (volume_id, root)),
  lac AS (SELECT * FROM cleared SEMI JOIN (SELECT volume_id, root FROM cleared GROUP BY ALL
    HAVING count(*) BETWEEN 3 AND 899) USING (volume_id, root))"""
SIZES = "sizes AS (SELECT volume_id, root, count(*) AS voxels FROM lab GROUP BY ALL)"
MOMENTS = ", ".join(
    [f"round(avg({a}) + 1, 6) AS centroid_{a}" for a in "xyz"]
    + [f"round((max({a}) - min({a}) + 1) * {VOXEL_UM}::DOUBLE, 6) AS bbox_{a}_um" for a in "xyz"]
)
SPARSE_BLOCKS = f"""{SPARSE}, bl AS (SELECT unnest([0, 1, 2]::BIGINT[]) AS block,
    unnest([0, 7, 14]) AS z_start, unnest([10, 17, 24]) AS z_end),
  blocked AS (SELECT volume_id, block, z, y, x FROM sparse JOIN bl ON z >= z_start AND z < z_end)"""
FACES = """pairs AS (SELECT a.volume_id, a.root, count(*) AS p FROM lac a JOIN lac b
    ON a.volume_id = b.volume_id AND a.root = b.root
    AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL),
  faces AS (SELECT volume_id, root, voxels, 6 * voxels - coalesce(p, 0) AS faces
    FROM (SELECT volume_id, root, count(*) AS voxels FROM lac GROUP BY ALL)
    LEFT JOIN pairs USING (volume_id, root))"""


#: One row for each configuration of a cell's eight corners, from the operator's rule.
MESH_TABLE = ", ".join(f"({n}, {a!r}::DOUBLE, {v!r}::DOUBLE)" for n, a, v in mesh.cell_table())


def _density_sql(lacunar: str) -> str:
    return f"""RECURSIVE {DENSE}, bl AS (SELECT unnest([0, 1, 2]::BIGINT[]) AS block,
      unnest([0, 4, 8]) AS z_start, unnest([5, 9, 12]) AS z_end),
    image AS (SELECT volume_id, block, z, y, x, v FROM dense JOIN bl ON z >= z_start AND z < z_end),
    bright AS (SELECT * FROM image WHERE v > 30),
    {labels_sql("bright", "volume_id, block", 18, DENSE_SHAPE)},
    {otsu_sql("image", ["volume_id", "block"], "v")},
    found AS (SELECT volume_id, block, count(DISTINCT root) AS lacunae, count(*) AS voxels
      FROM lab GROUP BY ALL),
    base AS (SELECT volume_id, block, count(*) AS n, count(*) FILTER (v <= threshold) AS dark
      FROM image JOIN otsu USING (volume_id, block) GROUP BY ALL),
    vols AS (SELECT volume_id, block, coalesce(lacunae, 0) AS lacunae,
        coalesce(voxels, 0) * {lacunar} AS lacunar_um3, dark * {CELL!r}::DOUBLE AS background_um3,
        n * {CELL!r}::DOUBLE - dark * {CELL!r}::DOUBLE - coalesce(voxels, 0) * {lacunar} AS tissue_um3
      FROM base LEFT JOIN found USING (volume_id, block))"""


DENSITY_COLUMNS = """SELECT volume_id, block, lacunae, round(lacunar_um3, 4) AS lacunar_um3,
  round(background_um3, 4) AS background_um3, round(tissue_um3, 4) AS tissue_um3,
  round(CASE WHEN tissue_um3 > 0 THEN lacunae / tissue_um3 ELSE 0 END, 8) AS lacunae_per_tissue,
  round(CASE WHEN tissue_um3 > 0 THEN lacunar_um3 / tissue_um3 ELSE 0 END, 8) AS volume_fraction
  FROM vols"""


def _summary_sql(column: str, expression: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS count, round(avg({expression}), 4) AS mean,
      round(stddev_pop({expression}), 4) AS std, round(min({expression}), 4) AS min,
      round(max({expression}), 4) AS max, round(quantile_cont({expression}, 0.5), 4) AS median,
      round(quantile_cont({expression}, 0.25), 4) AS q25,
      round(quantile_cont({expression}, 0.75), 4) AS q75 FROM faces"""


ORACLES = {
    "components6": f"WITH {LABELS6} SELECT volume_id, voxel, root FROM lab",
    "components26": f"WITH {LABELS26} SELECT volume_id, voxel, root FROM lab",
    "components_2d": f"""WITH RECURSIVE {SPARSE},
      {labels_sql("sparse", "volume_id, z", 4, SPARSE_SHAPE, 2)} SELECT volume_id, voxel, root FROM lab""",
    "component_sizes": f"""WITH {LABELS6}, {SIZES}, numbered AS (SELECT *, row_number() OVER
        (PARTITION BY volume_id ORDER BY root) AS component_id FROM sizes)
      SELECT volume_id, component_id, voxels AS voxel_count,
        round(voxels * {CELL!r}::DOUBLE, 4) AS volume_um3 FROM numbered WHERE voxels BETWEEN 3 AND 8""",
    "component_csv": f"""WITH {LABELS18}, {SIZES}, numbered AS (SELECT *, row_number() OVER
        (PARTITION BY volume_id ORDER BY root) AS component_id FROM sizes)
      SELECT volume_id, component_id, voxels AS voxel_count,
        round(voxels * {CELL!r}::DOUBLE, 4) AS volume_um3, true AS included_after_filtering
      FROM numbered WHERE voxels >= 2""",
    "component_totals": f"""WITH {LABELS6}, {SIZES}
      SELECT volume_id, count(*) FILTER (voxels BETWEEN 2 AND 6) AS n_components, count(*) AS n_before,
        coalesce(sum(voxels) FILTER (voxels BETWEEN 2 AND 6), 0)::BIGINT AS total_voxels,
        max(voxels) FILTER (voxels BETWEEN 2 AND 6) AS largest,
        count(*) FILTER (voxels NOT BETWEEN 2 AND 6) AS n_removed,
        round(coalesce(sum(voxels) FILTER (voxels BETWEEN 2 AND 6), 0) * {CELL!r}::DOUBLE, 4) AS total_um3
      FROM sizes GROUP BY volume_id""",
    "class_components": f"""WITH RECURSIVE {SPARSE},
      {labels_sql("sparse", "volume_id, label", 26, SPARSE_SHAPE)}
      SELECT volume_id, CASE label WHEN 1 THEN 'lacunae' ELSE 'cracks' END AS class_name,
        count(DISTINCT root) AS components, count(*) AS voxels FROM lab GROUP BY ALL""",
    "paired_component_counts": f"""WITH RECURSIVE {SPARSE},
      offs7 AS (SELECT unnest([0,0,0,0,0,-1,1]) AS dz, unnest([0,0,0,-1,1,0,0]) AS dy,
        unnest([0,-1,1,0,0,0,0]) AS dx),
      grown AS (SELECT DISTINCT volume_id, z + dz AS z, y + dy AS y, x + dx AS x FROM sparse, offs7
        WHERE z + dz BETWEEN 0 AND {SPARSE_SHAPE[0] - 1} AND y + dy BETWEEN 0 AND {SPARSE_SHAPE[1] - 1}
          AND x + dx BETWEEN 0 AND {SPARSE_SHAPE[2] - 1}),
      closed AS (SELECT volume_id, z - dz AS z, y - dy AS y, x - dx AS x FROM grown, offs7
        GROUP BY ALL HAVING count(*) = 7),
      sides AS (SELECT volume_id, 'a' AS side, z, y, x FROM sparse
        UNION ALL SELECT volume_id, 'b', z, y, x FROM closed),
      {labels_sql("sides", "volume_id, side", 6, SPARSE_SHAPE)},
      n AS (SELECT volume_id, count(DISTINCT root) FILTER (side = 'a') AS n_a,
        count(DISTINCT root) FILTER (side = 'b') AS n_b FROM lab GROUP BY ALL)
      SELECT *, n_b < n_a AS b_has_fewer, n_a - n_b AS difference FROM n""",
    "clear_border": f"""WITH {LABELS6} SELECT volume_id, voxel, root FROM lab
      ANTI JOIN (SELECT DISTINCT volume_id, root FROM lab WHERE {_near_border(SPARSE_SHAPE)})
      USING (volume_id, root)""",
    "sample_id": """WITH p AS (SELECT p_partkey, p_type, replace(p_name, ' ', '.') AS n FROM part)
      SELECT p_partkey, CASE WHEN p_type IN ('STANDARD', 'MEDIUM')
        THEN regexp_replace(n, '(.)\\.[^.]*$', '\\1')
        WHEN p_type = 'PROMO' THEN n || '_lacunae' ELSE n END AS sample_id FROM p""",
    "lacuna_moments": f"""WITH {LACUNAE} SELECT volume_id, root, count(*) AS voxels, {MOMENTS}
      FROM lac GROUP BY ALL""",
    "lacuna_band": f"""WITH {LABELS26}, {SIZES} SELECT volume_id, root, voxels, row_number() OVER
        (PARTITION BY volume_id ORDER BY root) AS component_id FROM sizes
      WHERE voxels BETWEEN 58 AND 899""",
    "shape_axes": f"""WITH {LACUNAE}, c AS (SELECT volume_id, root, count(*) AS voxels, covar_pop(x, x) AS a,
        covar_pop(y, y) AS b, covar_pop(z, z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f
        FROM lac GROUP BY ALL),
      q AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2
        + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM c),
      r AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e)
        + e * (d * f - (b - q) * e)) / (p * p * p) / 2))) / 3 AS phi FROM q),
      v AS (SELECT *, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS raw3 FROM r),
      w AS (SELECT *, CASE WHEN raw3 < 1e-6::DOUBLE THEN 0 ELSE raw3 END AS e3,
        CASE WHEN 3 * q - e1 - raw3 < 1e-6::DOUBLE THEN 0 ELSE 3 * q - e1 - raw3 END AS e2 FROM v)
      SELECT volume_id, root, voxels,
        round(CASE WHEN e1 - e3 < {morpho.EQUAL_AXES!r}::DOUBLE THEN 0 ELSE (sqrt(e1) - sqrt(e3)) / sqrt(e1) END, 4) AS stretch,
        round(CASE WHEN e1 - e3 < {morpho.EQUAL_AXES!r}::DOUBLE THEN 0
          ELSE 2 * (sqrt(e2) - sqrt(e3)) / (sqrt(e1) - sqrt(e3)) - 1 END, 4) AS oblateness,
        round(e1 / 2 * {VOXEL_UM}::DOUBLE, 4) AS major_um, round(e3 * {VOXEL_UM}::DOUBLE, 4) AS minor_um,
        round(e3 / (e1 / 2), 4) AS axis_ratio FROM w""",
    "exposed_faces": f"""WITH {LACUNAE}, {FACES} SELECT volume_id, root, voxels, faces,
      round(faces * {VOXEL_UM**2!r}::DOUBLE, 6) AS surface_um2, round(faces / voxels, 6) AS ratio_raw,
      round(faces / voxels / {VOXEL_UM}::DOUBLE, 6) AS ratio_um FROM faces""",
    "mesh_surface": f"""WITH {LACUNAE}, configs(configuration, area, inside) AS (VALUES {MESH_TABLE}),
      corner AS (SELECT o AS k, o // 4 AS dz, o // 2 % 2 AS dy, o % 2 AS dx FROM range(0, 8) u(o)),
      cells AS (SELECT volume_id, root, z - dz AS z, y - dy AS y, x - dx AS x, CAST(sum(1 << k) AS INTEGER) AS configuration
        FROM lac, corner GROUP BY ALL),
      m AS (SELECT volume_id, root, sum(area) AS a, sum(inside) AS v FROM cells JOIN configs USING (configuration) GROUP BY ALL),
      n AS (SELECT volume_id, root, count(*) AS voxels FROM lac GROUP BY ALL)
      SELECT volume_id, root, voxels, round(a, 6) AS mesh_area, round(v, 6) AS mesh_volume,
        round(a * {VOXEL_UM**2!r}::DOUBLE, 6) AS mesh_area_um2, round(v * {VOXEL_UM**3!r}::DOUBLE, 6) AS mesh_volume_um3,
        round(a / v, 6) AS mesh_ratio_raw,
        round(a * {VOXEL_UM**2!r}::DOUBLE / (voxels * {VOXEL_UM**3!r}::DOUBLE), 6) AS mesh_ratio_um
      FROM n JOIN m USING (volume_id, root)""",
    "dedupe_centroids": f"""WITH RECURSIVE {SPARSE_BLOCKS},
      {labels_sql("blocked", "volume_id, block", 18, SPARSE_SHAPE)},
      m AS (SELECT volume_id, block, root, count(*) AS voxels, round_even(avg(x) + 1, 6) AS centroid_x,
        round_even(avg(y) + 1, 6) AS centroid_y, round_even(avg(z) + 1, 6) AS centroid_z
        FROM lab GROUP BY ALL HAVING count(*) BETWEEN 2 AND 899),
      u AS (SELECT * FROM m QUALIFY row_number() OVER
        (PARTITION BY volume_id, centroid_x, centroid_y, centroid_z ORDER BY block, root) = 1)
      SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY block, root) AS lacuna_id FROM u""",
    "block_density": f"WITH {_density_sql(f'{CELL!r}::DOUBLE')} {DENSITY_COLUMNS}",
    "block_density_legacy": f"WITH {_density_sql('1.0::DOUBLE')} {DENSITY_COLUMNS}",
    "global_density": f"""WITH {_density_sql(f'{CELL!r}::DOUBLE')}
      SELECT volume_id, round(sum(lacunar_um3), 3) AS lacunar_um3, round(sum(tissue_um3), 3) AS tissue_um3,
        round(sum(lacunar_um3) / sum(tissue_um3), 8) AS density FROM vols GROUP BY volume_id
      HAVING sum(tissue_um3) > 0""",
    "lacuna_summary": f"""WITH {LACUNAE}, {FACES} {_summary_sql("volume", "voxels::DOUBLE")}
      UNION ALL {_summary_sql("surface_um2", f"faces * {VOXEL_UM**2!r}::DOUBLE")}""",
}
