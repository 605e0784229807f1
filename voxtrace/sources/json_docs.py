"""JSON documents with a read status instead of a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_status(text: Column) -> Column:
    """``missing``, ``invalid_json``, ``not_object`` or ``ok`` for one document text."""
    parsed = F.try_parse_json(text)
    # The parser stops after the first value; text left behind it breaks one of the wrappers.
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    whole = parsed.isNotNull() & in_array.isNotNull() & in_object.isNotNull()
    return (
        F.when(text.isNull(), "missing")
        .when(~whole, "invalid_json")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_object")
        .otherwise("ok")
    )


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file below ``path``: its name, text and read status."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        .withColumn("status", json_status(F.col("text")))
    )
