"""Reference library of labelled blocks: discovery and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("sample_identifier", "patient_id", "class_label", "disease", "morphometry_csv")
    ]
    + [T.StructField(n, T.IntegerType()) for n in ("step", "z_index", "slice_start", "slice_end")]
    + [T.StructField("section_name", T.StringType()), T.StructField("block_depth_px", T.IntegerType())]
)


def read_library(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every block folder below ``root``, with the folder name and file presence."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    metadata = (
        spark.read.json(f"{root}/*/metadata.json", schema=METADATA_SCHEMA, multiLine=True)
        .withColumn("folder", folder)
        .withColumn("morphometry_csv", F.coalesce("morphometry_csv", F.lit("morphometry.csv")))
    )
    present = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select(
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
            F.regexp_extract("path", r"([^/]+)$", 1).alias("morphometry_csv"),
            F.lit(True).alias("csv_exists"),
        )
    )
    return metadata.join(present, ["folder", "morphometry_csv"], "left").withColumn(
        "csv_exists", F.coalesce("csv_exists", F.lit(False))
    )


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) == "", F.lit(True))


def _leaves_folder(path: str) -> Column:
    """True if a relative path climbs above its folder at any step, or is absolute."""
    depth = F.aggregate(
        F.split(F.col(path), "/"),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("lowest")),
        lambda acc, part: F.struct(
            (
                acc["now"]
                + F.when(part == "..", -1).when((part == ".") | (part == ""), 0).otherwise(1)
            ).alias("now"),
            F.least(
                acc["lowest"], acc["now"] + F.when(part == "..", -1).otherwise(0)
            ).alias("lowest"),
        ),
        lambda acc: acc["lowest"] < 0,
    )
    return F.col(path).startswith("/") | depth


def validate_library(blocks: DataFrame) -> DataFrame:
    """Add ``label`` (class label or its older name) and ``error``, the first broken rule."""
    label = F.when(~_blank("class_label"), F.col("class_label")).otherwise(F.col("disease"))
    labelled = blocks.withColumn("label", label)
    rules = [
        (_blank("sample_identifier"), "missing sample_identifier"),
        (F.col("sample_identifier") != F.col("folder"), "sample_identifier mismatch"),
        (_blank("patient_id"), "missing patient_id"),
        (_blank("label"), "missing class_label"),
        *[
            (F.col(k).isNull(), f"{k} must be an integer")
            for k in ("step", "z_index", "slice_start", "slice_end")
        ],
        (F.col("slice_start") >= F.col("slice_end"), "slice_start must be lower than slice_end"),
        (_blank("morphometry_csv"), "morphometry_csv must be a path string"),
        (_leaves_folder("morphometry_csv"), "morphometry_csv must resolve inside the folder"),
        (~F.col("csv_exists"), "morphometry_csv not found"),
    ]
    return labelled.withColumn(
        "error", F.coalesce(*[F.when(broken, message) for broken, message in rules])
    )
