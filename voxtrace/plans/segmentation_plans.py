"""Queries over mask metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrace.operators import segmentation as seg
from voxtrace.operators import volume as vol
from voxtrace.operators.ordered import dealt
from voxtrace.plans.views_sql import MASKS, SPARSE
from voxtrace.sources.tables import mask_pair, sparse_grid, table

PAIR = ["pair"]
PLACE = ["row_id", "col_id"]


def _counts(spark, sf_dir):
    prediction, truth = mask_pair(spark, sf_dir)
    return seg.confusion(seg.contingency(prediction, truth, PAIR, PLACE), PAIR)


def contingency(spark, sf_dir):
    prediction, truth = mask_pair(spark, sf_dir)
    return seg.contingency(prediction, truth, PAIR, PLACE)


def sparse_confusion(spark, sf_dir):
    """Masks that list their foreground only, in volumes of 10 cells more than either lists."""
    prediction, truth = mask_pair(spark, sf_dir)
    some, other = prediction.where("label <> 0"), truth.where("label <> 0")
    places = some.select(*PAIR, *PLACE).unionByName(other.select(*PAIR, *PLACE))
    cells = dealt(places, [*PAIR, *PLACE]).distinct().groupBy(*PAIR).agg((F.count("*") + 10).alias("cells"))
    return seg.confusion(seg.contingency(some, other, PAIR, PLACE, cells), PAIR)


def confusion(spark, sf_dir):
    return _counts(spark, sf_dir)


def seg_metrics(spark, sf_dir):
    rows = seg.label_metrics(_counts(spark, sf_dir), list(seg.METRICS))
    return rows.drop("tp", "fp", "fn", "tn", "hallucinated")


def hallucinated(spark, sf_dir):
    return _counts(spark, sf_dir).where("hallucinated").select("pair", "label")


def class_names(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.pmod("p_size", F.lit(5)).cast("bigint").alias("label"),
        (F.col("p_size") > 25).alias("hallucinated"),
    )
    return labels.select(
        "p_partkey",
        seg.class_name(F.col("label"), F.col("hallucinated")).alias("class_name"),
    )


def mask_guard(spark, sf_dir):
    line = F.col("l_linenumber")
    masks = table(spark, sf_dir, "lineitem").select(
        line.cast("bigint").alias("pair"),
        F.when(line <= 3, F.col("l_quantity")).otherwise(F.col("l_discount") * 100).alias("label"),
    )
    return seg.mask_guard(masks, PAIR)


def shape_match(spark, sf_dir):
    voxels = sparse_grid(spark, sf_dir)
    left = vol.geometry(voxels)
    right = vol.geometry(voxels.where((F.col("v") > 5) & (F.col("volume_id") != 1) & (F.col("x") < 35)))
    return seg.shape_match(left, right)


def seg_batch(spark, sf_dir):
    return seg.batch_summary(seg.label_metrics(_counts(spark, sf_dir)))


def seg_batch_status(spark, sf_dir):
    return seg.batch_status(shape_match(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        contingency, confusion, sparse_confusion, seg_metrics, hallucinated, class_names, mask_guard, shape_match,
        seg_batch, seg_batch_status,
    )
}

COUNTS = f"""{MASKS}, labels AS (SELECT pair, gt AS label FROM masks WHERE gt <> 0
    UNION SELECT pair, pred FROM masks WHERE pred <> 0),
  counts AS (SELECT pair, label,
      count(*) FILTER (pred = label AND gt = label) AS tp,
      count(*) FILTER (pred = label AND gt <> label) AS fp,
      count(*) FILTER (pred <> label AND gt = label) AS fn,
      count(*) FILTER (pred <> label AND gt <> label) AS tn,
      count(*) FILTER (gt = label) = 0 AS hallucinated
    FROM masks JOIN labels USING (pair) GROUP BY pair, label)"""


def _safe(top: str, bottom: str) -> str:
    return f"round_even(CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) ELSE 0 END, 4)"


FORMULAS = {
    "dice": _safe("2 * tp", "2 * tp + fp + fn"),
    "f1": _safe("2 * tp", "2 * tp + fp + fn"),
    "iou": _safe("tp", "tp + fp + fn"),
    "jaccard": _safe("tp", "tp + fp + fn"),
    "precision": _safe("tp", "tp + fp"),
    "recall": _safe("tp", "tp + fn"),
    "sensitivity": _safe("tp", "tp + fn"),
    "accuracy": _safe("tp + tn", "tp + fp + fn + tn"),
}
NAME = """CASE label WHEN 1 THEN 'lacunae' WHEN 2 THEN 'cracks' ELSE 'class_' || label
  || CASE WHEN hallucinated THEN '_hallucinated' ELSE '' END END"""
SHAPES = f"""{SPARSE}, a AS (SELECT volume_id, max(z) + 1 AS left_n_slices, max(y) + 1 AS left_height,
    max(x) + 1 AS left_width FROM sparse GROUP BY volume_id),
  b AS (SELECT volume_id, max(z) + 1 AS right_n_slices, max(y) + 1 AS right_height,
    max(x) + 1 AS right_width FROM sparse WHERE v > 5 AND volume_id <> 1 AND x < 35 GROUP BY volume_id),
  matched AS (SELECT *, CASE WHEN left_height IS NULL THEN 'missing_left' WHEN right_height IS NULL
      THEN 'missing_right' WHEN left_n_slices = right_n_slices AND left_height = right_height
      AND left_width = right_width THEN 'ok' ELSE 'shape_mismatch' END AS status
    FROM a FULL JOIN b USING (volume_id))"""

ORACLES = {
    "contingency": f"WITH {MASKS} SELECT pair, gt, pred, count(*) AS n FROM masks GROUP BY ALL",
    "confusion": f"WITH {COUNTS} SELECT * FROM counts",
    "sparse_confusion": """WITH cells AS (SELECT l_suppkey AS pair, l_orderkey, l_linenumber,
        max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END)::BIGINT AS pred,
        max(CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END)::BIGINT AS gt FROM lineitem GROUP BY ALL),
      p AS (SELECT * FROM cells WHERE pred <> 0), t AS (SELECT * FROM cells WHERE gt <> 0),
      met AS (SELECT pair, coalesce(p.pred, 0) AS pred, coalesce(t.gt, 0) AS gt
        FROM p FULL JOIN t USING (pair, l_orderkey, l_linenumber)),
      sizes AS (SELECT pair, count(*) + 10 AS cells FROM met GROUP BY pair),
      labels AS (SELECT pair, pred AS label FROM met WHERE pred <> 0 UNION SELECT pair, gt FROM met WHERE gt <> 0),
      counts AS (SELECT pair, label, count(*) FILTER (pred = label AND gt = label) AS tp,
        count(*) FILTER (pred = label AND gt <> label) AS fp,
        count(*) FILTER (pred <> label AND gt = label) AS fn,
        count(*) FILTER (gt = label) = 0 AS hallucinated FROM met JOIN labels USING (pair) GROUP BY pair, label)
      SELECT pair, label, tp, fp, fn, cells - tp - fp - fn AS tn, hallucinated FROM counts JOIN sizes USING (pair)""",
    "seg_metrics": f"""WITH {COUNTS} SELECT pair, label, {NAME} AS class_name,
      {", ".join(f"{f} AS {m}" for m, f in FORMULAS.items())} FROM counts""",
    "hallucinated": f"""WITH {MASKS} SELECT pair, pred AS label FROM masks WHERE pred <> 0
      EXCEPT SELECT pair, gt FROM masks""",
    "class_names": f"""WITH l AS (SELECT p_partkey, p_size % 5 AS label, p_size > 25 AS hallucinated
      FROM part) SELECT p_partkey, {NAME} AS class_name FROM l""",
    "mask_guard": """WITH l AS (SELECT DISTINCT l_linenumber::BIGINT AS pair, round_even(CASE WHEN
        l_linenumber <= 3 THEN l_quantity ELSE l_discount * 100 END, 0)::BIGINT AS label FROM lineitem),
      g AS (SELECT pair, count(*) AS labels, count(*) FILTER (label NOT IN (1, 2)) AS unknown,
        min(label) AS smallest, max(label) AS largest FROM l WHERE label <> 0 GROUP BY pair)
      SELECT *, labels >= 16 AND unknown >= 8 AND largest >= 31
        AND labels / (largest - smallest + 1) >= 0.8::DOUBLE AS rejected FROM g""",
    "shape_match": f"WITH {SHAPES} SELECT * FROM matched",
    "seg_batch": f"""WITH {COUNTS}, m AS (SELECT {NAME} AS class_name,
        unnest(['dice', 'iou', 'precision', 'recall', 'f1']) AS metric,
        unnest([{", ".join(FORMULAS[m] for m in seg.DEFAULT_METRICS)}]) AS value FROM counts)
      SELECT class_name, metric, count(*) AS pairs, round_even(avg(value), 4) AS mean,
        round_even(stddev_pop(value), 4) AS std FROM m GROUP BY ALL""",
    "seg_batch_status": f"""WITH {SHAPES} SELECT count(*) FILTER (status = 'ok') AS successful_pairs,
      count(*) FILTER (status <> 'ok') AS failed_pairs, count(*) FILTER (status = 'ok') = 0 AS all_failed
      FROM matched""",
}
