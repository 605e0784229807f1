"""Queries over the table-audit operators and the CSV source."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxtrace.functions.rounding import round_columns
from voxtrace.functions.student_t import mean_half_width_sql
from voxtrace.operators import audit
from voxtrace.operators.audit import Condition
from voxtrace.plans.views_sql import MISSING
from voxtrace.session import staging_path
from voxtrace.sources.csv_table import read_csv_table
from voxtrace.sources.tables import lineitem_with_missing, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def src_csv_infer(spark, sf_dir):
    path = staging_path(spark, "lineitem") + ".csv"
    table(spark, sf_dir, "lineitem").write.csv(path, header=True)
    return read_csv_table(spark, path)


def audit_structure(spark, sf_dir):
    return audit.structure_audit(lineitem_with_missing(spark, sf_dir))


def audit_missing(spark, sf_dir):
    return audit.missing_columns(lineitem_with_missing(spark, sf_dir))


def col_aggs(spark, sf_dir):
    rows = audit.column_aggregates(
        lineitem_with_missing(spark, sf_dir),
        [*MEASURES, "l_returnflag"],
        ("count", "missing", "mean", "std", "min", "max", "median", "sum"),
    )
    return round_columns(rows, {"mean": 4, "std": 4, "median": 4, "sum": 1})


def col_std_pop(spark, sf_dir):
    rows = audit.column_aggregates(
        table(spark, sf_dir, "lineitem"), None, ("count", "std"), ddof=0
    )
    return round_columns(rows, {"std": 4})


def group_aggs(spark, sf_dir):
    rows = audit.grouped_aggregates(
        lineitem_with_missing(spark, sf_dir),
        ["l_linestatus", "l_returnflag"],
        ["l_quantity", "l_tax"],
        ("count", "mean", "std", "min", "max", "median", "sum"),
    )
    digits = {f"{op}_{c}": 4 for op in ("mean", "std", "median") for c in ("l_quantity", "l_tax")}
    return round_columns(rows, {**digits, "sum_l_quantity": 1, "sum_l_tax": 1})


CONDITIONS = [
    Condition("large_quantity", "l_quantity", ">", 25),
    Condition("taxed", "l_tax", "gte", 0.05),
    Condition("not_untaxed", "l_tax", "!=", 0),
    Condition("text_number", "l_discount", "lt", "0.05"),
    Condition("shipped", "l_linestatus", "==", "F"),
    Condition("not_open", "l_linestatus", "!=", "O"),
]


def cond_counts(spark, sf_dir):
    return round_columns(
        audit.conditional_counts(lineitem_with_missing(spark, sf_dir), CONDITIONS),
        {"fraction": 6},
    )


def text_conditions(spark, sf_dir):
    """Conditions as texts, thresholds and aliases, with columns named loosely."""
    given = [
        "L Quantity > 25",
        "l_linestatus == 'F'",
        {"column": "l-tax", "gte": 0.05, "lt": 0.02},
        {"name": "discount", "column": "l_discount", "le": 0.03},
        {"column": "l_returnflag", "op": "not_equal", "value": "R"},
    ]
    counts = audit.count_conditions(lineitem_with_missing(spark, sf_dir), given)
    return round_columns(counts, {"fraction": 6})


def preview(spark, sf_dir):
    return audit.preview(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        ["o_orderkey"],
        20,
    )


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def numeric_summary(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").select(
        *[F.col(c).cast("string").alias(c) for c in ORDER_COLUMNS]
    )
    return round_columns(
        audit.text_number_summary(texts, ORDER_COLUMNS), {"mean": 3, "std": 3}
    )


def feature_summary(spark, sf_dir):
    rows = audit.seven_number_summary(
        table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]
    )
    return round_columns(rows, {c: 4 for c in ("mean", "std", "median", "q25", "q75")})


def two_level_stats(spark, sf_dir):
    rows = audit.overall_statistics(table(spark, sf_dir, "lineitem"), [], F.col("l_quantity"))
    return round_columns(rows, {"mean": 6, "std": 6})


def list_stats(spark, sf_dir):
    rows = audit.list_statistics(
        table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding"
    )
    return round_columns(rows, {c: 6 for c in rows.columns if c != "vec_id"})


def scalar_math(spark, sf_dir):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    unit = size / 100
    columns = {
        "root": F.sqrt(price),
        "root_shifted": F.sqrt(size - 10),
        "natural_log": F.log(price),
        "log_shifted": F.log(size - 10),
        "exponential": F.exp(unit),
        "sine": F.sin(size),
        "cosine": F.cos(size),
        "tangent": F.tan(unit),
        "arc_sine": F.asin(unit),
        "arc_cosine": F.acos(unit),
        "arc_tangent": F.atan(size),
        "absolute": F.abs(size - 25),
        "floored": F.floor(price / 7).cast("double"),
        "ceiled": F.ceil(price / 7).cast("double"),
        "power": F.pow(size, F.lit(3)),
        "modulo": audit.python_modulo(size, F.lit(7.0)),
        "modulo_negative": audit.python_modulo(size, F.lit(-7.0)),
        "circle": F.lit(math.pi) * size * size,
    }
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        *[F.round(audit.finite_or_null(c), 6).alias(n) for n, c in columns.items()],
        (audit.finite_or_null(F.log(size - 10)).isNull()).alias("log_error"),
    )


def ci95(spark, sf_dir):
    return round_columns(
        audit.mean_interval(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity"),
        {"mean": 4},
    )


QUERIES = {
    f.__name__: f
    for f in (
        src_csv_infer, audit_structure, audit_missing, col_aggs, col_std_pop, group_aggs,
        cond_counts, text_conditions, preview, numeric_summary, feature_summary, two_level_stats, list_stats,
        scalar_math, ci95,
    )
}

STRUCTURE = [
    ("l_orderkey", "bigint", True), ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True),
    ("l_linenumber", "int", True), ("l_quantity", "double", True),
    ("l_extendedprice", "double", True), ("l_discount", "double", True), ("l_tax", "double", True),
    ("l_returnflag", "string", False), ("l_linestatus", "string", False),
    ("l_shipdate", "timestamp_ntz", False),
]


def _one_column(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count,
      count(*) - count({column}) AS missing, round(avg({column}), 4) AS mean,
      round(stddev_samp({column}), 4) AS std, min({column}) AS min, max({column}) AS max,
      round(quantile_cont({column}, 0.5), 4) AS median, round(sum({column}), 1) AS sum
    FROM missing"""


def _std_column(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count,
      round(stddev_pop({column}), 4) AS std FROM lineitem"""


def _condition(name: str, column: str, test: str) -> str:
    return f"""SELECT '{name}' AS name, count(*) FILTER ({test}) AS count,
      count({column}) AS valid_count, count(*) - count({column}) AS missing_excluded,
      round(count(*) FILTER ({test}) / count({column}), 6) AS fraction FROM missing"""


def _text_column(column: str) -> str:
    value = f"TRY_CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", count({value}) AS count,
      round(avg({value}), 3) AS mean, round(stddev_pop({value}), 3) AS std,
      min({value}) AS min, max({value}) AS max FROM texts"""


def _seven(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count,
      round(avg({column}), 4) AS mean, round(stddev_pop({column}), 4) AS std,
      min({column})::DOUBLE AS min, max({column})::DOUBLE AS max,
      round(quantile_cont({column}::DOUBLE, 0.5), 4) AS median,
      round(quantile_cont({column}::DOUBLE, 0.25), 4) AS q25,
      round(quantile_cont({column}::DOUBLE, 0.75), 4) AS q75 FROM part"""


def _group_columns(column: str) -> str:
    return f"""count({column}) AS count_{column}, round(avg({column}), 4) AS mean_{column},
      round(stddev_samp({column}), 4) AS std_{column}, min({column}) AS min_{column},
      max({column}) AS max_{column}, round(quantile_cont({column}, 0.5), 4) AS median_{column},
      coalesce(round(sum({column}), 1), 0.0) AS sum_{column}"""


ORACLES = {
    "src_csv_infer": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
      strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000') AS l_shipdate FROM lineitem""",
    "audit_structure": f"WITH {MISSING} "
    + " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS position, '{c}' AS "column", '{t}' AS dtype, {n} AS "numeric",
        count(*) AS rows, count(*) - count({c}) AS missing FROM missing"""
        for i, (c, t, n) in enumerate(STRUCTURE)
    ),
    "audit_missing": f"WITH {MISSING}, counted AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM missing"""
        for c, _, _ in STRUCTURE
    )
    + ") SELECT * FROM counted WHERE missing > 0",
    "col_aggs": f"WITH {MISSING} "
    + " UNION ALL ".join(_one_column(c) for c in MEASURES)
    + """ UNION ALL SELECT 'l_returnflag', count(l_returnflag), count(*) - count(l_returnflag),
      NULL, NULL, NULL, NULL, NULL, NULL FROM missing""",
    "col_std_pop": " UNION ALL ".join(
        _std_column(c) for c, _, numeric in STRUCTURE if numeric
    ),
    "group_aggs": f"""WITH {MISSING}, grouped AS (
      SELECT l_linestatus, l_returnflag, count(*) AS rows, {_group_columns("l_quantity")},
        {_group_columns("l_tax")}, FALSE AS truncated
      FROM missing GROUP BY l_linestatus, l_returnflag)
      SELECT * FROM grouped""",
    "cond_counts": f"WITH {MISSING} "
    + " UNION ALL ".join(
        [
            _condition("large_quantity", "l_quantity", "l_quantity > 25"),
            _condition("taxed", "l_tax", "l_tax >= 0.05::DOUBLE"),
            _condition("not_untaxed", "l_tax", "l_tax <> 0"),
            _condition("text_number", "l_discount", "l_discount < 0.05::DOUBLE"),
            _condition("shipped", "l_linestatus", "l_linestatus = 'F'"),
            _condition("not_open", "l_linestatus", "l_linestatus <> 'O'"),
        ]
    ),
    "text_conditions": f"WITH {MISSING} "
    + " UNION ALL ".join(
        [
            _condition("L Quantity > 25", "l_quantity", "l_quantity > 25"),
            _condition("l_linestatus == ''F''", "l_linestatus", "l_linestatus = 'F'"),
            _condition("l-tax >= 0.05", "l_tax", "l_tax >= 0.05::DOUBLE"),
            _condition("l-tax < 0.02", "l_tax", "l_tax < 0.02::DOUBLE"),
            _condition("discount <= 0.03", "l_discount", "l_discount <= 0.03::DOUBLE"),
            _condition("l_returnflag != R", "l_returnflag", "l_returnflag <> 'R'"),
        ]
    ),
    "preview": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
      ORDER BY o_orderkey LIMIT 20""",
    "numeric_summary": "WITH texts AS (SELECT "
    + ", ".join(f"{c}::VARCHAR AS {c}" for c in ORDER_COLUMNS)
    + " FROM orders) "
    + " UNION ALL ".join(_text_column(c) for c in ORDER_COLUMNS),
    "feature_summary": _seven("p_size") + " UNION ALL " + _seven("p_retailprice"),
    "two_level_stats": """SELECT count(*) AS count, round(avg(l_quantity), 6) AS mean,
      round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max
      FROM lineitem""",
    "list_stats": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
        FROM embeddings)
      SELECT vec_id, round(list_sum(e), 6) AS sum, round(list_avg(e), 6) AS mean,
        round(list_var_pop(e), 6) AS pvariance, round(list_stddev_pop(e), 6) AS pstdev,
        round(list_var_samp(e), 6) AS variance, round(list_stddev_samp(e), 6) AS stdev,
        round(list_median(e), 6) AS median, round(list_min(e), 6) AS min,
        round(list_max(e), 6) AS max FROM v""",
    "scalar_math": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS r FROM part)
      SELECT p_partkey, round(sqrt(r), 6) AS root,
        CASE WHEN s >= 10 THEN round(sqrt(greatest(s - 10, 0)), 6) END AS root_shifted,
        round(ln(r), 6) AS natural_log,
        CASE WHEN s > 10 THEN round(ln(greatest(s - 10, 0.5::DOUBLE)), 6) END AS log_shifted,
        round(exp(s / 100), 6) AS exponential, round(sin(s), 6) AS sine,
        round(cos(s), 6) AS cosine, round(tan(s / 100), 6) AS tangent,
        round(asin(s / 100), 6) AS arc_sine, round(acos(s / 100), 6) AS arc_cosine,
        round(atan(s), 6) AS arc_tangent, abs(s - 25) AS absolute,
        floor(r / 7) AS floored, ceil(r / 7) AS ceiled, pow(s, 3) AS power,
        s - 7 * floor(s / 7) AS modulo, s + 7 * floor(s / -7) AS modulo_negative,
        round(pi() * s * s, 6) AS circle, s <= 10 AS log_error FROM p""",
    "ci95": f"""WITH g AS (SELECT l_suppkey, count(l_quantity) AS n, avg(l_quantity) AS m,
        stddev_samp(l_quantity) AS s FROM lineitem GROUP BY l_suppkey)
      SELECT l_suppkey, n, round(m, 4) AS mean, {mean_half_width_sql("n", "s")} AS half_width
      FROM g""",
}
