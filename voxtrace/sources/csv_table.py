"""Header CSV source with inferred types and one missing-value rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtrace.operators.audit import nan_to_null

# Cell texts that mean "missing".
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


TEXT, BOOLEAN, DOUBLE, WHOLE = range(4)


def _cell_kind(column: str):
    """Narrowest kind of a cell; the smallest kind in a column is the column's."""
    cell = F.col(f"`{column}`")
    return (
        F.when(cell.rlike(r"^[+-]?\d{1,18}$"), WHOLE)
        .when(cell.try_cast("double").isNotNull(), DOUBLE)
        .when(F.lower(cell).isin("true", "false"), BOOLEAN)
        .when(cell.isNotNull(), TEXT)
    )


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a ``.csv`` file or folder; whole numbers become bigint, other numbers double.

    Without a schema every column is read as text first and typed by what all its cells
    allow, so that a missing marker never turns a numeric column into text. Give a schema
    for very large inputs to save that pass.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError(f"Expected a .csv file, got: {path}")
    if schema is not None:
        return nan_to_null(spark.read.csv(path, header=True, schema=schema))
    text = spark.read.csv(path, header=True)
    cells = text.select(
        *[
            F.when(~F.col(f"`{c}`").isin(MISSING_TEXTS), F.col(f"`{c}`")).alias(c)
            for c in text.columns
        ]
    )
    fits = cells.agg(
        *[
            F.struct(F.min(_cell_kind(c)).alias("least"), F.max(_cell_kind(c)).alias("most")).alias(f"c{i}")
            for i, c in enumerate(cells.columns)
        ]
    ).head()
    typed = []
    for i, c in enumerate(cells.columns):
        least, most, column = fits[f"c{i}"]["least"], fits[f"c{i}"]["most"], F.col(f"`{c}`")
        if least is None or least == DOUBLE:
            column = column.cast("double")
        elif least == WHOLE:
            column = column.cast("bigint")
        elif least == most == BOOLEAN:
            column = column.cast("boolean")
        typed.append(column.alias(c))
    return nan_to_null(cells.select(*typed))
