"""Exact percentiles with linear interpolation over data of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here the ranks
that are wanted are bracketed: each scan counts values in bins between the ends of a bracket
(map-side, so a task hands on one row per bin), and the bin that holds a rank, cut to the least
and the largest value in it, is the rank's next bracket. A bracket of few rows is sorted. No row
of the data is shuffled but those of the last brackets.

Tables of more than ``GROUPS`` groups, values that are not finite and values so unevenly spread
that ``ROUNDS`` scans don't settle them are ranked by a range-partitioned running count instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from voxtrace.operators.ordered import running_total

#: Groups, and ranks of all groups and columns, that are bracketed (a row each on the driver).
GROUPS, TARGETS = 1000, 20_000
BINS, ROUNDS = 4096, 8
#: Rows of a bracket that are sorted as one array.
SORTED = 4096


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float],
) -> DataFrame:
    """One row per (keys, column) with ``p0, p1, ...`` in the order of ``probabilities``.

    Missing values are ignored; a column with no values yields no row. The data are read a few
    times; brackets and results of a bounded number of groups pass through the driver.
    """
    found = _bracketed(df, keys, columns, probabilities)
    return _ranked(df, keys, columns, probabilities) if found is None else found


def _cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, _column, value): a row for each value that is not missing."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("_column"), F.col(f"`{c}`").cast("double").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(*keys, F.inline(cells)).where("value is not null")


def _bracketed(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame | None:
    spark = df.sparkSession
    schema = StructType(
        [df.schema[k] for k in keys]
        + [StructField("column", StringType())]
        + [StructField(f"p{i}", DoubleType()) for i in range(len(probabilities))]
    )
    if not columns:
        return spark.createDataFrame([], schema)
    ends = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        ends += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    groups = df.groupBy(*keys).agg(*ends).limit(GROUPS + 1).collect()
    if len(groups) > GROUPS or len(groups) * len(columns) * len(probabilities) * 2 > TARGETS:
        return None

    # a target is (group, column, rank); open ones have a bracket (lo, hi, rows before it)
    solved: dict[tuple[int, int, int], float] = {}
    brackets: dict[tuple[int, int, float, float], tuple[int, int, set[int]]] = {}

    def place(group: int, column: int, rank: int, lo: float, hi: float, before: int, rows: int) -> None:
        if lo == hi:
            solved[group, column, rank] = lo
        else:
            brackets.setdefault((group, column, lo, hi), (before, rows, set()))[2].add(rank)

    for g, row in enumerate(groups):
        for c in range(len(columns)):
            n, lo, hi = row[f"n{c}"], row[f"lo{c}"], row[f"hi{c}"]
            for p in probabilities if n else ():
                for rank in {math.floor(float(p) * (n - 1)), math.ceil(float(p) * (n - 1))}:
                    place(g, c, rank, lo, hi, 0, n)
    names = [[row[k] for k in keys] for row in groups]
    cells = _cells(df, keys, columns)
    for _ in range(ROUNDS):
        if not brackets:
            break
        if any(not math.isfinite(hi - lo) for _, _, lo, hi in brackets):
            return None
        now, brackets = list(brackets.items()), {}
        for b, lo, hi, before, rows, rank in _narrow(spark, cells, keys, names, df.schema, now):
            (group, column, _, _), (base, _, _) = now[b]
            place(group, column, rank, lo, hi, base + before, rows)
    if brackets:
        return None
    out = []
    for g, row in enumerate(groups):
        for c, name in enumerate(columns):
            n = row[f"n{c}"]
            if not n:
                continue
            values = []
            for p in probabilities:
                position = float(p) * (n - 1)
                low, high = math.floor(position), math.ceil(position)
                fraction = position - low
                values.append(solved[g, c, low] * (1 - fraction) + solved[g, c, high] * fraction)
            out.append((*names[g], name, *values))
    return spark.createDataFrame(out, schema)


def _narrow(spark, cells: DataFrame, keys: Sequence[str], names: list, types: StructType, now: list) -> list:
    """(bracket, lo, hi, rows before within it, rows, rank) for each rank of each bracket."""
    fields = [StructField(f"_key{i}", types[k].dataType) for i, k in enumerate(keys)]
    table = spark.createDataFrame(
        [(*names[g], c, b, lo, hi, rows) for b, ((g, c, lo, hi), (_, rows, _)) in enumerate(now)],
        StructType(fields).add("_of", IntegerType()).add("_b", IntegerType()).add("_lo", DoubleType()).add("_hi", DoubleType()).add("_rows", LongType()),
    )
    wanted = spark.createDataFrame(
        [(b, rank - before, rank) for b, (_, (before, _, ranks)) in enumerate(now) for rank in ranks],
        "_b int, _at long, _rank long",
    )
    same = F.col("_column") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}"))
    # at most TARGETS rows
    inside = cells.join(F.broadcast(table), same & F.col("value").between(F.col("_lo"), F.col("_hi")))

    def held(before: Column, n: Column) -> Column:
        return (before <= F.col("_at")) & (F.col("_at") < before + n)

    share = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS
    found = []
    if any(rows > SORTED for _, (_, rows, _) in now):
        binned = (
            inside.where(F.col("_rows") > SORTED)
            .groupBy("_b", F.least(F.floor(share), F.lit(BINS - 1)).cast("int").alias("_bin"))
            .agg(F.count("*").alias("_n"), F.min("value").alias("_least"), F.max("value").alias("_most"))
        )
        # at most BINS rows a bracket
        up_to = Window.partitionBy("_b").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = binned.withColumn("_before", F.sum("_n").over(up_to) - F.col("_n"))
        hit = before.join(F.broadcast(wanted), "_b").where(held(F.col("_before"), F.col("_n")))
        found += hit.select("_b", "_least", "_most", "_before", "_n", "_rank").collect()
    if any(rows <= SORTED for _, (_, rows, _) in now):
        lists = inside.where(F.col("_rows") <= SORTED).groupBy("_b").agg(F.sort_array(F.collect_list("value")).alias("_v"))
        one = F.element_at("_v", (F.col("_at") + 1).cast("int"))
        found += (
            lists.join(F.broadcast(wanted), "_b")
            .select("_b", one, one.alias("_same"), "_at", F.lit(1).cast("long"), "_rank")
            .collect()
        )
    return found


def _ranked(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float],
) -> DataFrame:
    """By a running count of distinct values over ranges: for any number of groups and values."""
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_column") + 1)
    counted = (
        _cells(df, keys, columns).groupBy(*keys, named.alias("column"), "value").agg(F.count("*").alias("_n"))
    )
    group = [*keys, "column"]
    ranked = running_total(counted, group, ["value"], F.col("_n"), "_cum", total="_total")

    parts = []
    holds_any = F.lit(False)
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        fraction = position - low

        def holds(rank):
            return (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))

        holds_any = holds_any | holds(low) | holds(high)
        parts.append(
            F.sum(
                F.when(holds(low), F.col("value") * (1 - fraction)).otherwise(0.0)
                + F.when(holds(high), F.col("value") * fraction).otherwise(0.0)
            ).alias(f"p{i}")
        )
    return ranked.where(holds_any).groupBy(*group).agg(*parts)
