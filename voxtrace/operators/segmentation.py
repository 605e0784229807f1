"""Mask metrics from one contingency table per pair of masks.

Both masks are rows (keys..., coordinates..., label). They are joined once on the coordinate;
every label's counts are margins of the small table that follows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.operators.ordered import dealt

# Default class names and the metrics reported by default.
CLASS_MAP = {1: "lacunae", 2: "cracks"}
DEFAULT_METRICS = ("dice", "iou", "precision", "recall", "f1")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0))).otherwise(0.0)


def dice(tp, fp, fn, tn):
    return _ratio(2 * tp, 2 * tp + fp + fn)


def iou(tp, fp, fn, tn):
    return _ratio(tp, tp + fp + fn)


def precision(tp, fp, fn, tn):
    return _ratio(tp, tp + fp)


def recall(tp, fp, fn, tn):
    return _ratio(tp, tp + fn)


def accuracy(tp, fp, fn, tn):
    return _ratio(tp + tn, tp + fp + fn + tn)


METRICS = {
    "dice": dice, "f1": dice, "iou": iou, "jaccard": iou, "precision": precision,
    "recall": recall, "sensitivity": recall, "accuracy": accuracy,
}


def supported_metrics(requested: Sequence[str]) -> tuple[list[str], list[str]]:
    """Known and unknown metric names, each once; an error if none is known."""
    names = list(dict.fromkeys(m.strip().lower() for m in requested))
    known = [m for m in names if m in METRICS]
    if not names:
        raise ValueError("At least one metric is needed")
    if not known:
        raise ValueError(f"No supported metric among {list(requested)}")
    return known, [m for m in names if m and m not in METRICS]


def contingency(
    prediction: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    coordinates: Sequence[str],
    cells: DataFrame | None = None,
) -> DataFrame:
    """(keys, gt, pred, n); labels of float masks are rounded half to even first.

    A cell that only one mask has is background in the other. ``cells`` (keys, cells) gives the
    size of each volume where masks leave background out; the cells of neither mask are counted
    as background in both; a cell listed more than once has its largest label. Both masks are
    stacked and met in one aggregation, behind one shuffle of their rows.
    """
    def labels(mask: DataFrame, gt: Column, pred: Column) -> DataFrame:
        return mask.select(*keys, *coordinates, gt.alias("gt"), pred.alias("pred"))

    label, none = F.rint("label").cast("bigint"), F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    stacked = labels(prediction, none, label).unionByName(labels(truth, label, none))
    met = (
        dealt(stacked, [*keys, *coordinates])
        .groupBy(*keys, *coordinates)
        .agg(F.coalesce(F.max("gt"), zero).alias("gt"), F.coalesce(F.max("pred"), zero).alias("pred"))
    )
    table = met.groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))
    if cells is None:
        return table
    seen = table.groupBy(*keys).agg(F.sum("n").alias("_seen"))
    rest = cells.join(seen, list(keys), "left").select(
        *keys, zero.alias("gt"), zero.alias("pred"), (F.col("cells") - F.coalesce("_seen", zero)).alias("n")
    )
    return table.unionByName(rest.where("n > 0")).groupBy(*keys, "gt", "pred").agg(F.sum("n").alias("n"))


def confusion(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn per label other than 0, with the hallucinated flag."""
    same = F.col("gt") == F.col("pred")
    zero = F.lit(0).cast("bigint")
    margins = table.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("gt").alias("label"),
                    F.col("n").alias("in_gt"),
                    zero.alias("in_pred"),
                    F.when(same, F.col("n")).otherwise(zero).alias("both"),
                ),
                F.struct(
                    F.col("pred").alias("label"),
                    zero.alias("in_gt"),
                    F.col("n").alias("in_pred"),
                    zero.alias("both"),
                ),
            )
        ),
    )
    totals = table.groupBy(*keys).agg(F.sum("n").alias("_total"))
    counts = margins.groupBy(*keys, "label").agg(
        F.sum("both").alias("tp"), F.sum("in_gt").alias("_gt"), F.sum("in_pred").alias("_pred")
    )
    return (
        counts.where("label <> 0")
        .join(totals, list(keys))
        .select(
            *keys,
            "label",
            "tp",
            (F.col("_pred") - F.col("tp")).alias("fp"),
            (F.col("_gt") - F.col("tp")).alias("fn"),
            (F.col("_total") - F.col("_pred") - F.col("_gt") + F.col("tp")).alias("tn"),
            (F.col("_gt") == 0).alias("hallucinated"),
        )
    )


def class_name(label: Column, hallucinated: Column, names: Mapping[int, str] = CLASS_MAP) -> Column:
    plain = F.concat(F.lit("class_"), label.cast("string"))
    mapped = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in names.items()])
    return F.coalesce(
        mapped, F.when(hallucinated, F.concat(plain, F.lit("_hallucinated"))).otherwise(plain)
    )


def label_metrics(counts: DataFrame, metrics: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """Class name and metrics, rounded to 4 decimals, per label."""
    known, _ = supported_metrics(metrics)
    four = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return counts.select(
        "*",
        class_name(F.col("label"), F.col("hallucinated")).alias("class_name"),
        *[F.bround(METRICS[m](*four), 4).alias(m) for m in known],
    )


def mask_guard(
    masks: DataFrame, keys: Sequence[str], names: Mapping[int, str] = CLASS_MAP
) -> DataFrame:
    """Flag masks whose labels look like intensities: many, mostly unknown, dense and high."""
    labels = (
        masks.select(*keys, F.rint("label").cast("bigint").alias("label"))
        .where("label <> 0")
        .distinct()
    )
    found, span = F.col("labels"), F.col("largest") - F.col("smallest") + 1
    return (
        labels.groupBy(*keys)
        .agg(
            F.count("*").alias("labels"),
            F.count_if(~F.col("label").isin(*names)).alias("unknown"),
            F.min("label").alias("smallest"),
            F.max("label").alias("largest"),
        )
        .withColumn(
            "rejected",
            (found >= 16)
            & (F.col("unknown") >= 8)
            & (F.col("largest") >= 31)
            & (found / span >= 0.8),
        )
    )


def shape_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Status of every pair of volumes: ok, shape_mismatch, missing_left or missing_right."""
    sizes = ("n_slices", "height", "width")
    a = left.select("volume_id", *[F.col(s).alias(f"left_{s}") for s in sizes])
    b = right.select("volume_id", *[F.col(s).alias(f"right_{s}") for s in sizes])
    same = F.lit(True)
    for s in sizes:
        same = same & F.col(f"left_{s}").eqNullSafe(F.col(f"right_{s}"))
    return a.join(b, "volume_id", "full").withColumn(
        "status",
        F.when(F.col("left_height").isNull(), "missing_left")
        .when(F.col("right_height").isNull(), "missing_right")
        .when(same, "ok")
        .otherwise("shape_mismatch"),
    )


def refuse_same_source(prediction: Column, truth: Column) -> Column:
    """True where both masks of a pair are one file."""
    return F.regexp_replace(prediction, "/+", "/") == F.regexp_replace(truth, "/+", "/")


def batch_summary(measured: DataFrame, metrics: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """Mean and population std per class and metric over the pairs that have the class."""
    long = measured.select(
        "class_name",
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        ),
    )
    return long.groupBy("class_name", "metric").agg(
        F.count("*").alias("pairs"),
        F.bround(F.avg("value"), 4).alias("mean"),
        F.bround(F.stddev_pop("value"), 4).alias("std"),
    )


def batch_status(statuses: DataFrame) -> DataFrame:
    """Successful and failed pairs; ``all_failed`` marks a batch without any result."""
    return statuses.agg(
        F.count_if(F.col("status") == "ok").alias("successful_pairs"),
        F.count_if(F.col("status") != "ok").alias("failed_pairs"),
    ).withColumn("all_failed", F.col("successful_pairs") == 0)
