"""Readers for the driver's tables and the views that stand in for imaging data and run traces.

Each view is derived from whole tables and keeps a constant density as the tables grow: more
suppliers or users mean more volumes, not fuller ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DENSE_SHAPE = (12, 31, 7)  # z, y, x of one dense volume
SPARSE_SHAPE = (24, 30, 40)  # z, y, x of one sparse volume
VOXEL_UM = 1.6  # edge of a voxel in micrometres


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing tax on line 7 and a missing status on returned rows."""
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("l_tax", F.when(F.col("l_linenumber") != 7, F.col("l_tax")))
        .withColumn("l_linestatus", F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")))
    )


def dense_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels (volume_id, z, y, x, v): one intensity volume per 50 suppliers.

    z is the month, y the day and x the line number; cells without a row, such as the days that
    a month lacks, are 0.
    """
    depth, height, width = DENSE_SHAPE
    place = ["volume_id", "z", "y", "x"]
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.floor(F.col("l_suppkey") / 50).cast("bigint").alias("volume_id"),
            (F.month("l_shipdate") - 1).cast("bigint").alias("z"),
            (F.dayofmonth("l_shipdate") - 1).cast("bigint").alias("y"),
            (F.col("l_linenumber") - 1).cast("bigint").alias("x"),
        )
        .agg(F.round(F.sum("l_quantity") / F.count("*")).alias("v"))
    )
    volumes = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_suppkey") / 50).cast("bigint").alias("volume_id")
    ).distinct()
    grid = volumes
    for name, extent in zip(place[1:], (depth, height, width), strict=True):
        grid = grid.select("*", F.explode(_places(extent)).alias(name))
    empty = grid.withColumn("v", F.lit(None).cast("double"))
    # stacked and met in one aggregation: at most one row of each cell has a value
    return cells.unionByName(empty).groupBy(*place).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))


IMAGE_SHAPE = (100, 92)  # y, x of one quantity image


def _places(extent: int):
    return F.sequence(F.lit(0).cast("bigint"), F.lit(extent - 1).cast("bigint"))


def quantity_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels (volume_id, z, y, x, v): two images per 50 suppliers, one per line status.

    y follows the quantity (two rows per unit, the second for larger discounts), x is a
    quarter of the day of the year, v the mean discounted quantity in hundredths; cells
    without a row are 0.
    """
    height, width = IMAGE_SHAPE
    net = F.col("l_quantity") * (100 - F.round(F.col("l_discount") * 100))
    lower = F.when(F.round(F.col("l_discount") * 100) > 5, 1).otherwise(0)
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.floor(F.col("l_suppkey") / 50).cast("bigint").alias("volume_id"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(0).cast("bigint").alias("z"),
            ((F.col("l_quantity") - 1) * 2 + lower).cast("bigint").alias("y"),
            F.floor((F.dayofyear("l_shipdate") - 1) / 4).cast("bigint").alias("x"),
        )
        .agg(F.round(F.sum(net) / F.count("*")).alias("v"))
    )
    images = cells.select("volume_id", "z").distinct()
    grid = images.select(
        "*", F.explode(_places(height)).alias("y")
    ).select("*", F.explode(_places(width)).alias("x"))
    return grid.join(cells, ["volume_id", "z", "y", "x"], "left").withColumn(
        "v", F.coalesce("v", F.lit(0.0))
    )


def sparse_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground voxels (volume_id, z, y, x, label, v): one mask per 40 users.

    Label 2 marks cells with an error event, label 1 all other cells.
    """
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.floor(F.col("user_id") / 40).cast("bigint").alias("volume_id"),
            F.hour("ts").cast("bigint").alias("z"),
            (F.dayofmonth("ts") - 1).cast("bigint").alias("y"),
            F.pmod(F.col("user_id"), F.lit(40)).cast("bigint").alias("x"),
        )
        .agg(
            F.max(F.when(F.col("event_type") == "error", 2).otherwise(1))
            .cast("bigint")
            .alias("label"),
            (F.sum("value") / F.count("*")).alias("v"),
        )
    )


def mask_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Prediction and ground truth masks, one pair of masks per supplier.

    A coordinate is (l_orderkey, l_linenumber); repeated coordinates stand for their largest label.
    """
    items = table(spark, sf_dir, "lineitem")
    coordinate = [
        F.col("l_suppkey").alias("pair"),
        F.col("l_orderkey").alias("row_id"),
        F.col("l_linenumber").cast("bigint").alias("col_id"),
    ]
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    predicted = F.when(flag == "A", 1.0).when(flag == "N", 2.0).otherwise(0.0)
    truth = F.when(status == "F", 1.0).otherwise(0.0)
    return items.select(*coordinate, predicted.alias("label")), items.select(*coordinate, truth.alias("label"))


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of every block (supplier)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("block_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
    )


def block_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block metadata: patient = nation of the supplier, class = its region."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("block_id"),
            F.col("s_name").alias("sample_identifier"),
            F.col("n_name").alias("patient_id"),
            F.col("r_name").alias("class_label"),
            F.col("s_acctbal").alias("acctbal"),
        )
    )


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows: run = user; the order of a run is always (ts, event_id)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        "event_id",
        "ts",
        F.col("event_type").alias("route"),
        (F.col("event_type") != "error").alias("success"),
        F.col("props").alias("args"),
        "value",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), "turn", F.col("role").alias("type"), "text"
    )


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order, with a status."""
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_custkey").alias("task_id"),
            F.col("o_orderkey").alias("run_id"),
            F.col("o_orderdate").alias("batch_time"),
            F.when(status == "F", "passed").when(status == "O", "failed").otherwise("error").alias(
                "status"
            ),
            F.col("o_totalprice").alias("price"),
        )
    )
