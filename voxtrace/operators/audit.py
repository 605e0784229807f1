"""Table audits: structure, per-column and grouped aggregates, conditional counts, summaries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtrace.operators.quantiles import exact_percentiles

DEFAULT_OPERATIONS = ("count", "mean", "std", "min", "max")
NUMERIC_OPERATIONS = ("mean", "std", "min", "max", "median", "sum")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN counts as missing everywhere else, so turn it into null once."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[
            F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")).alias(c) if c in floats
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def is_number(data_type: T.DataType, booleans: bool = False) -> bool:
    """Numeric test; the aggregates count booleans as numbers, column selection does not."""
    if isinstance(data_type, T.BooleanType):
        return booleans
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]


def select_columns(df: DataFrame, requested: Sequence[str] | None = None) -> list[str]:
    """Requested columns, or every numeric one; unknown names are an error."""
    if requested is None:
        return numeric_columns(df)
    unknown = [c for c in requested if c not in df.columns]
    if unknown:
        raise ValueError(f"Unknown CSV columns: {unknown}")
    return list(requested)


def structure_audit(df: DataFrame) -> DataFrame:
    """One row per column: position, dtype, numeric flag, row count, missing count."""
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    described = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(is_number(f.dataType)).alias("numeric"),
                F.col("rows").alias("rows"),
                F.col(f"m{i}").alias("missing"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    return counts.select(F.inline(described))


def missing_columns(df: DataFrame) -> DataFrame:
    """Only the columns that have missing values."""
    return structure_audit(df).where("missing > 0").select("column", "missing")


def _numeric_value(df: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.BooleanType):
        value = value.cast("int")
    return value.cast("double")


def _aggregate(df: DataFrame, column: str, operation: str, ddof: int) -> Column:
    raw = F.col(f"`{column}`")
    if operation == "count":
        return F.count(raw)
    if operation == "missing":
        return F.count_if(raw.isNull())
    if not is_number(df.schema[column].dataType, booleans=True):
        return F.max(F.lit(None).cast("double"))
    value = _numeric_value(df, column)
    if operation == "mean":
        return F.avg(value)
    if operation == "std":
        return F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    if operation == "min":
        return F.min(value)
    if operation == "max":
        return F.max(value)
    if operation == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    raise ValueError(f"Unknown operation: {operation}")


def _medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    numeric = [c for c in columns if is_number(df.schema[c].dataType, booleans=True)]
    values = df.select(*keys, *[_numeric_value(df, c).alias(c) for c in numeric])
    return exact_percentiles(values, keys, numeric, [0.5])


def column_aggregates(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    operations: Sequence[str] = DEFAULT_OPERATIONS,
    ddof: int = 1,
) -> DataFrame:
    """One row per column with one field per operation; non-numeric columns give null."""
    chosen = select_columns(df, columns)
    simple = [op for op in operations if op != "median"]
    wide = df.agg(
        *[
            _aggregate(df, c, op, ddof).alias(f"{op}_{i}")
            for i, c in enumerate(chosen)
            for op in simple
        ]
    )
    rows = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), *[F.col(f"{op}_{i}").alias(op) for op in simple]
                    )
                    for i, c in enumerate(chosen)
                ]
            )
        )
    )
    if "median" not in operations:
        return rows
    medians = _medians(df, [], chosen).withColumnRenamed("p0", "median")
    return rows.join(medians, "column", "left").select("column", *operations)


def grouped_aggregates(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    operations: Sequence[str] = DEFAULT_OPERATIONS,
    max_groups: int | None = None,
    ddof: int = 1,
) -> DataFrame:
    """All groups, or the first ``max_groups`` by key, missing keys last, with a truncation flag."""
    if max_groups is not None and max_groups < 1:
        raise ValueError("max_groups must be at least 1")
    select_columns(df, keys)
    chosen = select_columns(df, columns)
    simple = [op for op in operations if op != "median"]
    order = [F.col(f"`{k}`").asc_nulls_last() for k in keys]
    groups = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *[_aggregate(df, c, op, ddof).alias(f"{op}_{c}") for c in chosen for op in simple],
    )
    groups = groups.select(F.struct(*keys).alias("_key"), "*")
    if max_groups is None:
        groups = groups.withColumn("truncated", F.lit(False))
    else:
        groups = (
            groups.orderBy(*order)
            .limit(max_groups + 1)
            .agg(F.collect_list(F.struct("*")).alias("_g"))
            .select(
                F.inline(F.slice("_g", 1, max_groups)), (F.size("_g") > max_groups).alias("truncated")
            )
        )
    if "median" in operations:
        keyed = df.select(F.struct(*keys).alias("_key"), *[F.col(f"`{c}`") for c in chosen])
        if max_groups is not None:
            keyed = keyed.join(F.broadcast(groups.select("_key")), "_key", "left_semi")  # so many keys
        medians = _medians(keyed, ["_key"], chosen)
        for c in chosen:
            one = medians.where(F.col("column") == c).select(
                "_key", F.col("p0").alias(f"median_{c}")
            )
            groups = groups.join(one, "_key", "left")
    if max_groups is not None:
        groups = groups.orderBy(*order)  # so many rows
    return groups.drop("_key")


@dataclass(frozen=True)
class Condition:
    """A named comparison of one column with a literal."""

    name: str
    column: str
    op: str
    value: object


# The comparison operators and their accepted aliases.
COMPARISONS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
ALIASES = {
    "gt": ">", "greater_than": ">",
    "gte": ">=", "ge": ">=", "greater_than_or_equal": ">=",
    "lt": "<", "less_than": "<",
    "lte": "<=", "le": "<=", "less_than_or_equal": "<=",
    "eq": "==", "equals": "==",
    "ne": "!=", "neq": "!=", "not_equal": "!=",
}


def conditional_counts(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Count, valid count, excluded missing rows and fraction per condition, in one pass."""
    names = [c.name for c in conditions]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"Condition names must be unique: {repeated}")
    aggregates = []
    for i, cond in enumerate(conditions):
        if cond.column not in df.columns:
            raise ValueError(f"{cond.name}: there is no column {cond.column!r}")
        op = ALIASES.get(cond.op, cond.op)
        numeric = is_number(df.schema[cond.column].dataType, booleans=True)
        value = cond.value
        if numeric and isinstance(value, str):
            try:
                value = float(value)
            except ValueError as error:
                raise ValueError(
                    f"{cond.name}: {cond.value!r} is no number, but column {cond.column} is numeric"
                ) from error
        if not numeric and op in {">", ">=", "<", "<="}:
            raise ValueError(f"{cond.name}: {op} needs a numeric column, {cond.column} is not")
        column = F.col(f"`{cond.column}`")
        aggregates += [
            F.count_if(COMPARISONS[op](column, F.lit(value))).alias(f"n{i}"),
            F.count(column).alias(f"v{i}"),
            F.count_if(column.isNull()).alias(f"m{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c.name).alias("name"),
            F.col(f"n{i}").alias("count"),
            F.col(f"v{i}").alias("valid_count"),
            F.col(f"m{i}").alias("missing_excluded"),
            F.try_divide(F.col(f"n{i}"), F.col(f"v{i}")).alias("fraction"),
        )
        for i, c in enumerate(conditions)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


# The shorthand keys of a threshold.
THRESHOLDS = ("gt", "gte", "ge", "lt", "lte", "le", "eq", "ne", "neq")


def _literal(text: str) -> object:
    """The value a text names: a boolean, quoted text, a number, else the text itself."""
    text = text.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _from_text(text: str) -> Condition:
    text = text.strip()
    # the column is at least one character, so an operator is looked for behind it
    found = re.compile("[<>=!]=|[<>]").search(text, 1)
    if found is None or not text[found.end() :].strip():
        raise ValueError(f"{text!r} is no condition like 'Volume >= 50'")
    return Condition(text, text[: found.start()].strip(), found.group(), _literal(text[found.end() :]))


def parse_conditions(given: Sequence[object] | Mapping[str, object] | None) -> list[Condition]:
    """Conditions from what a user may write.

    ``given`` is a list of texts ("Volume >= 50"), of mappings with column, operator (or op) and
    value, of mappings with a column and thresholds (``{"column": c, "gt": 5, "lt": 9}``, each a
    condition of its own) and of conditions; or one mapping from texts to whether they are wanted.
    """
    if given is None:
        return []
    if isinstance(given, Mapping):
        return [_from_text(str(text)) for text, wanted in given.items() if wanted]
    conditions = []
    for item in given:
        if isinstance(item, Condition):
            conditions.append(item)
        elif isinstance(item, str):
            conditions.append(_from_text(item))
        elif not isinstance(item, Mapping) or "column" not in item:
            raise ValueError(f"A condition needs a column: {item!r}")
        else:
            column, name = str(item["column"]), item.get("name")
            limits = [(key, item[key]) for key in THRESHOLDS if key in item]
            for key, value in limits:
                op = ALIASES[key]
                first = name.strip() if isinstance(name, str) and name.strip() else column
                conditions.append(Condition(f"{first} {op} {value}", column, op, value))
            if limits:
                continue
            op = item.get("operator", item.get("op"))
            if op is None or "value" not in item:
                raise ValueError(f"A condition needs an operator and a value: {item!r}")
            op = ALIASES.get(str(op).strip().lower(), str(op).strip())
            conditions.append(Condition(name or f"{column} {op} {item['value']}", column, op, item["value"]))
    unknown = sorted({c.op for c in conditions} - {*COMPARISONS, *ALIASES})
    if unknown:
        raise ValueError(f"Unknown comparisons: {unknown}")
    return conditions


def find_column(df: DataFrame, wanted: str) -> str:
    """The column of this name, else the only one alike in letters (of any case) and digits."""
    if wanted in df.columns:
        return wanted

    def bare(name: str) -> str:
        return re.sub("[^a-z0-9]", "", name.lower())

    alike = [c for c in df.columns if bare(c) == bare(wanted)]
    if len(alike) != 1:
        raise ValueError(f"{wanted!r} names {'several columns: ' + ', '.join(alike) if alike else 'no column'}")
    return alike[0]


def count_conditions(df: DataFrame, given: Sequence[object] | Mapping[str, object] | None) -> DataFrame:
    """``conditional_counts`` of conditions as a user writes them, on the columns they mean."""
    conditions = [replace(c, column=find_column(df, c.column)) for c in parse_conditions(given)]
    if not conditions:
        return df.sparkSession.createDataFrame(
            [], "name string, count long, valid_count long, missing_excluded long, fraction double"
        )
    return conditional_counts(df, conditions)


def preview(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """First n rows in key order; non-finite numbers become null."""
    if n < 0:
        raise ValueError("preview rows can't be negative")
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    finite = [
        F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")).alias(c) if c in floats
        else F.col(f"`{c}`")
        for c in df.columns
    ]
    return df.orderBy(*key).limit(n).select(*finite)


def text_number_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population summary of columns whose cells may not all be numbers; bad cells are skipped."""
    def number(column: str) -> Column:
        value = F.col(f"`{column}`").try_cast("double")
        return F.when(~F.isnan(value), value)

    wide = df.agg(
        *[
            agg(number(c)).alias(f"{name}_{i}")
            for i, c in enumerate(columns)
            for name, agg in (
                ("count", F.count),
                ("mean", F.avg),
                ("std", F.stddev_pop),
                ("min", F.min),
                ("max", F.max),
            )
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{n}_{i}").alias(n) for n in ("count", "mean", "std", "min", "max")],
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def seven_number_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, population std, min, max, median, q25, q75 and count per column."""
    simple = column_aggregates(df, columns, ("count", "mean", "std", "min", "max"), ddof=0)
    spread = exact_percentiles(
        df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]),
        [],
        columns,
        [0.5, 0.25, 0.75],
    ).toDF("column", "median", "q25", "q75")
    return simple.join(spread, "column", "left")


def overall_statistics(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """count, mean, population std, min and max; Spark aggregates map-side and merges stably."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def list_statistics(df: DataFrame, column: str) -> DataFrame:
    """Statistics of an array column; sample statistics need two or more values."""
    values = F.transform(F.col(column), lambda x: x.cast("double"))
    n = F.size("_v")
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(
        "_v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))
    )
    middle = F.floor((n - 1) / 2).cast("int")
    upper = F.floor(n / 2).cast("int")
    return (
        df.withColumn("_v", F.array_sort(values))
        .where(n > 0)
        .withColumn("sum", total)
        .withColumn("mean", F.col("sum") / n)
        .withColumn("_q", squares)
        .withColumn("pvariance", F.col("_q") / n)
        .withColumn("pstdev", F.sqrt("pvariance"))
        .withColumn("variance", F.when(n > 1, F.col("_q") / F.nullif(n - 1, F.lit(0))))
        .withColumn("stdev", F.sqrt("variance"))
        .withColumn("median", (F.get("_v", middle) + F.get("_v", upper)) / 2)
        .withColumn("min", F.get("_v", F.lit(0)))
        .withColumn("max", F.get("_v", n - 1))
        .drop("_v", "_q", column)
    )


def python_modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    return F.when(b > 0, F.pmod(a, b)).when(b < 0, -F.pmod(-a, -b))


def finite_or_null(value: Column) -> Column:
    """Null instead of NaN or infinity, so that a domain error is visible as missing."""
    return F.when(F.abs(value) < float("inf"), value)


def mean_interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean and 95 % half-width of the mean per key."""
    from voxtrace.functions.student_t import mean_half_width

    return (
        df.groupBy(*keys)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("_std"),
        )
        .withColumn("half_width", mean_half_width(F.col("n"), F.col("_std")))
        .drop("_std")
    )
