"""Queries over sources, discovery and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrace.sources import catalog, slice_folders
from voxtrace.sources.json_docs import json_status
from voxtrace.sources.library import validate_library
from voxtrace.sources.tables import table


def src_json_status(spark, sf_dir):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.lit(None).cast("string"))
        .when(kind == "signup", F.concat("props", F.lit(",")))
        .when(kind == "view", F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", json_status(text).alias("status"))


def _pages(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", path.alias("path"), F.length("html").alias("size")
    )


def file_inventory(spark, sf_dir):
    return catalog.file_inventory(_pages(spark, sf_dir))


def inventory_totals(spark, sf_dir):
    return catalog.inventory_totals(_pages(spark, sf_dir), [".html"])


def _slice_files(spark, sf_dir):
    nation = F.col("s_nationkey")
    name = (
        F.when(nation == 3, F.regexp_replace("s_name", r"\d", "x"))
        .when(nation == 5, F.concat(F.lit("v"), F.col("s_suppkey"), F.lit("_1")))
        .otherwise(F.col("s_name"))
    )
    return table(spark, sf_dir, "supplier").select(
        nation.cast("bigint").alias("folder"), F.concat(name, F.lit(".tif")).alias("name")
    )


def slice_order(spark, sf_dir):
    files = _slice_files(spark, sf_dir).distinct()
    return catalog.order_slices(files, "folder", "name").drop("unnumbered_error")


def lib_validate(spark, sf_dir):
    nation = F.col("s_nationkey")
    blocks = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), nation == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("block_id"),
            F.col("s_name").alias("sample_identifier"),
            F.when(nation == 4, F.lower("s_name")).otherwise(F.col("s_name")).alias("folder"),
            F.when(nation == 7, F.lit(" ")).otherwise(F.col("n_name")).alias("patient_id"),
            F.when(~nation.isin(9, 10), F.col("n_name")).alias("class_label"),
            F.when(nation == 10, F.lit("legacy")).alias("disease"),
            F.when(nation != 11, nation).alias("step"),
            nation.alias("z_index"),
            F.floor("s_acctbal").cast("int").alias("slice_start"),
            F.lit(9000).alias("slice_end"),
            F.when(nation == 12, F.lit("a/../../m.csv")).otherwise(F.lit("a/../m.csv")).alias(
                "morphometry_csv"
            ),
            (nation != 13).alias("csv_exists"),
        )
    )
    return validate_library(blocks).select("block_id", "label", "error")


def numbered_runs(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("folder"), F.concat("c_name", F.lit(".tif")).alias("name")
    )
    return catalog.numbered_runs(files, "folder", "name")


def register_artifacts(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    requested = pages.select(
        F.when(F.col("path").endswith(".html"), F.concat("path", F.lit(".gz")))
        .otherwise(F.col("path"))
        .alias("path")
    )
    return catalog.register_artifacts(pages, requested, ["html"])


def register_ordered(spark, sf_dir):
    """Paths in the order of their request, last page first; every fifth page is no file."""
    pages = _pages(spark, sf_dir)
    path, number = F.col("path"), F.col("page_id")
    requested = pages.select(
        F.when(number % 7 == 0, F.concat(path, F.lit(".old"))).otherwise(path).alias("path"), (-number).alias("place")
    )
    catalogue = pages.select("path", (number % 5 > 0).alias("is_file"))
    return catalog.register_artifacts(catalogue, requested, ["html"], max_files=100)


def _order_slices(spark, sf_dir):
    """A slice per order, 1 x 7 quantities by line number; every tenth customer's slices end early."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.max(F.when(F.col("l_linenumber") == n, F.col("l_quantity"))).alias(f"q{n}") for n in range(1, 8)],
        F.max("l_linenumber").alias("lines"),
    )
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("o_custkey")
    width = F.when(key % 10 == 0, F.col("lines")).otherwise(7)
    pixels = F.array(*[F.coalesce(f"q{n}", F.lit(0.0)) for n in range(1, 8)])
    return orders.select(
        key.alias("folder"),
        F.when(key % 11 == 0, F.lit("x.tif")).otherwise(F.concat(F.lit("s"), "o_orderkey", F.lit(".tif"))).alias("name"),
        F.lit(1).alias("height"),
        width.cast("int").alias("width"),
        F.slice(pixels, 1, F.when(key % 13 == 0, width - 1).otherwise(width).cast("int")).alias("pixels"),
    )


def slice_folders_report(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("folder"))
    return slice_folders.volume_report(_order_slices(spark, sf_dir), "auto", customers)


def slice_folder_volumes(spark, sf_dir):
    volumes = slice_folders.folder_volumes(_order_slices(spark, sf_dir))
    return volumes.select(
        "volume_id", "z", "height", "width",
        F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x).alias("total"),
        F.element_at("pixels", 1).alias("first_pixel"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        src_json_status, file_inventory, inventory_totals, slice_order, lib_validate,
        numbered_runs, register_artifacts, register_ordered, slice_folders_report,
        slice_folder_volumes,
    )
}

PAGES = """files AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path,
         length(html) AS size FROM pages),
named AS (SELECT *, regexp_extract(path, '([^/]*)/*$', 1) AS name FROM files)"""

SLICES = """slices AS (SELECT o_custkey AS folder, o_orderkey,
    CASE WHEN o_custkey % 11 = 0 THEN 'x.tif' ELSE 's' || o_orderkey || '.tif' END AS name,
    CASE WHEN o_custkey % 10 = 0 THEN max(l_linenumber) ELSE 7 END::BIGINT AS width, sum(q) AS total,
    max(q) FILTER (l_linenumber = 1) AS q1
  FROM orders JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
    ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
report AS (SELECT folder, count(name) AS depth, min(width) AS a, max(width) AS b,
    CASE WHEN count(name) = 0 THEN 'no_slices' WHEN folder % 13 = 0 THEN 'broken_slice'
      WHEN min(width) < max(width) THEN 'unequal_shapes' WHEN count(name) > count(DISTINCT name) THEN 'repeated_slice'
      ELSE 'ok' END AS status
  FROM (SELECT c_custkey AS folder FROM customer) FULL JOIN slices USING (folder) GROUP BY folder)"""

ORACLES = {
    "slice_folders_report": f"""WITH {SLICES} SELECT folder, depth, CASE WHEN depth > 0 THEN 1::BIGINT END AS height,
      CASE WHEN a = b THEN a END AS width, status FROM report""",
    "slice_folder_volumes": f"""WITH {SLICES} SELECT folder AS volume_id,
        row_number() OVER (PARTITION BY folder ORDER BY o_orderkey) - 1 AS z, 1::BIGINT AS height, width, total,
        coalesce(q1, 0) AS first_pixel
      FROM slices JOIN report USING (folder) WHERE status = 'ok'""",
    "src_json_status": """WITH d AS (SELECT event_id, CASE event_type WHEN 'error' THEN NULL
        WHEN 'signup' THEN props || ',' WHEN 'view' THEN '[' || props || ']' ELSE props END AS doc
        FROM events)
      SELECT event_id, CASE WHEN doc IS NULL THEN 'missing' WHEN NOT json_valid(doc)
        THEN 'invalid_json' WHEN json_type(doc) <> 'OBJECT' THEN 'not_object' ELSE 'ok' END AS status
      FROM d""",
    "file_inventory": f"""WITH {PAGES}
      SELECT name, path, lower(regexp_extract(name, '[^.](\\.[^.]+)$', 1)) AS extension,
        length(regexp_replace(path, '[^/]', '', 'g')) AS depth, size AS bytes,
        round(size / 1048576, 6) AS megabytes FROM named""",
    "inventory_totals": f"""WITH {PAGES}, m AS (SELECT * FROM named WHERE name LIKE '_%.html')
      SELECT count(*) AS files, sum(size)::BIGINT AS bytes,
        count(DISTINCT lower(regexp_extract(name, '[^.](\\.[^.]+)$', 1))) AS extensions,
        false AS truncated FROM m""",
    "slice_order": """WITH f AS (SELECT DISTINCT s_nationkey::BIGINT AS folder,
        CASE s_nationkey WHEN 3 THEN regexp_replace(s_name, '[0-9]', 'x', 'g')
          WHEN 5 THEN 'v' || s_suppkey || '_1' ELSE s_name END || '.tif' AS name FROM supplier),
      i AS (SELECT *, TRY_CAST(list_extract(regexp_extract_all(
          regexp_replace(name, '\\.[^.]*$', ''), '[0-9]+'), -1) AS BIGINT) AS idx FROM f),
      n AS (SELECT *, bool_and(idx IS NOT NULL) OVER (PARTITION BY folder) AS "numeric" FROM i)
      SELECT folder, name, CASE WHEN "numeric" THEN idx END AS slice_index, "numeric",
        row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN "numeric" THEN idx ELSE -1 END,
          lower(name), name) AS position,
        "numeric" AND count(*) OVER (PARTITION BY folder, idx) > 1 AS duplicate FROM n""",
    "lib_validate": """SELECT s_suppkey AS block_id,
        CASE WHEN s_nationkey = 10 THEN 'legacy' WHEN s_nationkey = 9 THEN NULL ELSE n_name END AS label,
        CASE WHEN s_nationkey = 4 THEN 'sample_identifier mismatch'
          WHEN s_nationkey = 7 THEN 'missing patient_id'
          WHEN s_nationkey = 9 THEN 'missing class_label'
          WHEN s_nationkey = 11 THEN 'step must be an integer'
          WHEN floor(s_acctbal) >= 9000 THEN 'slice_start must be lower than slice_end'
          WHEN s_nationkey = 12 THEN 'morphometry_csv must resolve inside the folder'
          WHEN s_nationkey = 13 THEN 'morphometry_csv not found' END AS error
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "numbered_runs": """WITH p AS (SELECT c_mktsegment AS folder, c_name || '.tif' AS name,
        regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS number FROM customer),
      r AS (SELECT *, number - row_number() OVER (PARTITION BY folder ORDER BY number) AS island FROM p)
      SELECT folder, min(name) AS first_name, max(name) AS last_name, count(*) AS files,
        count(*) >= 3 AS folded FROM r GROUP BY folder, island""",
    "register_artifacts": f"""WITH {PAGES},
      asked AS (SELECT DISTINCT CASE WHEN path LIKE '%.html' THEN path || '.gz' ELSE path END AS path
        FROM files),
      found AS (SELECT path, min(origin) AS origin FROM (
          SELECT path, 0 AS origin FROM asked WHERE path IN (SELECT path FROM files)
          UNION ALL SELECT path, 1 FROM named WHERE name LIKE '_%.html') GROUP BY path)
      SELECT path, 'registered' AS status, row_number() OVER (ORDER BY origin, path) AS position
      FROM found
      UNION ALL
      SELECT path, 'not_found', NULL FROM asked WHERE path NOT IN (SELECT path FROM files)""",
    "register_ordered": f"""WITH {PAGES}, known AS (SELECT path, bool_or(page_id % 5 > 0) AS is_file FROM files GROUP BY path),
      asked AS (SELECT CASE WHEN page_id % 7 = 0 THEN path || '.old' ELSE path END AS path, min(-page_id) AS place
        FROM files GROUP BY 1),
      found AS (SELECT path, min((origin, place)) AS o FROM (
          SELECT path, 0 AS origin, place FROM asked WHERE path IN (SELECT path FROM known WHERE is_file)
          UNION ALL SELECT path, 1, 0 FROM named WHERE name LIKE '_%.html' AND path IN (SELECT path FROM known WHERE is_file))
        GROUP BY path),
      n AS (SELECT path, row_number() OVER (ORDER BY o, path) AS position FROM found)
      SELECT path, CASE WHEN position > 100 THEN 'over_limit' ELSE 'registered' END AS status,
        CASE WHEN position <= 100 THEN position END AS position FROM n
      UNION ALL SELECT path, CASE WHEN is_file IS NULL THEN 'not_found' ELSE 'not_a_file' END, NULL
      FROM asked LEFT JOIN known USING (path) WHERE NOT coalesce(is_file, false)""",
}
