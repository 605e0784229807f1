"""Rubric scores: completion, roll-ups, benchmark aggregates and pooled labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.functions.student_t import mean_half_width

# The thirteen one-point criteria (section, code, label, category).
RUBRIC = [
    ("routing", "A1", "correct_primary_route", "Correctness"),
    ("routing", "A2", "no_forbidden_routes", "Correctness"),
    ("routing", "A3", "no_redundant_routes", "Efficiency"),
    ("routing", "A4", "required_routes_present", "Completeness"),
    ("subgraph_task", "B1", "task_scope_adherence", "Quality"),
    ("subgraph_task", "B2", "no_redundant_task", "Efficiency"),
    ("tools", "C1", "correct_tools_called", "Correctness"),
    ("tools", "C2", "correct_tool_order", "Correctness"),
    ("tools", "C3", "sandbox_first_attempt", "Efficiency"),
    ("artifacts", "D1", "artifacts_created", "Completeness"),
    ("artifacts", "D2", "artifact_type_correct", "Correctness"),
    ("artifacts", "D3", "artifact_registered_in_session", "Correctness"),
    ("final_output", "E1", "final_output_correct", "Correctness"),
]
MAX_POINTS = len(RUBRIC)


CRITERIA = [f"{code}_{label}" for _, code, label, _ in RUBRIC]
SECTIONS = list(dict.fromkeys(r[0] for r in RUBRIC))


def run_points(
    runs: DataFrame, scored: DataFrame, skipped: DataFrame, carried: Sequence[str] = ()
) -> DataFrame:
    """(run_id, carried, points): the thirteen criteria of every run in the rubric's order.

    A point is the scored value, a full one if its section is skipped, else 0. ``scored`` has
    (run_id, criterion_id, earned), ``skipped`` has (run_id, section); where a criterion is
    scored twice, the larger value counts. ``carried`` are columns of ``runs`` to keep. All three
    inputs meet in one aggregation on run_id, so a run is one row of an exchange for each task.
    """
    places = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CRITERIA))
    sections = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SECTIONS))
    # text, since an expression of its own for each criterion takes seconds to build
    known = runs.selectExpr(
        "run_id", *[f"`{c}`" for c in carried], "CAST(NULL AS INT) AS _place", "CAST(NULL AS INT) AS _earned",
        "CAST(NULL AS INT) AS _section", "true AS _known",
    )
    given = scored.selectExpr(
        "run_id", f"CASE criterion_id {places} END AS _place", "CAST(earned AS INT) AS _earned",
        "CAST(NULL AS INT) AS _section", "false AS _known",
    )
    free = skipped.selectExpr(
        "run_id", "CAST(NULL AS INT) AS _place", "CAST(NULL AS INT) AS _earned",
        f"CASE section {sections} END AS _section", "false AS _known",
    )
    facts = known.unionByName(given, allowMissingColumns=True).unionByName(free, allowMissingColumns=True)
    wide = facts.groupBy("run_id").agg(
        *[F.max(c).alias(c) for c in carried],
        *[F.expr(f"max(CASE WHEN _place = {i} THEN _earned END) AS _p{i}") for i in range(MAX_POINTS)],
        *[F.expr(f"bool_or(_section = {i}) AS _s{i}") for i in range(len(SECTIONS))],
        F.expr("bool_or(_known) AS _known"),
    )
    cells = ", ".join(
        f"CAST(CASE WHEN _s{SECTIONS.index(r[0])} THEN 1 ELSE coalesce(_p{i}, 0) END AS BIGINT)"
        for i, r in enumerate(RUBRIC)
    )
    return wide.where("_known").selectExpr("run_id", *[f"`{c}`" for c in carried], f"array({cells}) AS points")


def criteria_of(points: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """A row for each criterion of each row of ``run_points``; no exchange."""
    rows = ", ".join(
        f"named_struct('section', '{section}', 'criterion_id', '{code}_{label}', 'dimension', '{code[0]}', "
        f"'category', '{category}', 'earned', points[{i}], 'max', 1L)"
        for i, (section, code, label, category) in enumerate(RUBRIC)
    )
    return points.selectExpr(*keys, f"inline(array({rows}))")


def complete_criteria(runs: DataFrame, scored: DataFrame, skipped: DataFrame) -> DataFrame:
    """All thirteen criteria of every run, a row each, from ``run_points``."""
    return criteria_of(run_points(runs, scored, skipped))


def _sums(levels: Sequence[tuple[str, int | None]], kind: str, name: str) -> str:
    """Rows (kind, name, earned, max) as SQL text: sums over fixed places of ``points``.

    A level is its name and what groups the places: a field of the rubric (a code counts by its
    letter), -1 for each criterion by itself, None for all of them.
    """
    cells = []
    for level, field in levels:
        groups: dict[str, list[int]] = {}
        for i, row in enumerate(RUBRIC):
            if field is None:
                group = "all"
            elif field < 0:
                group = CRITERIA[i]
            else:
                group = row[field][:1] if field == 1 else row[field]
            groups.setdefault(group, []).append(i)
        cells += [
            f"named_struct('{kind}', '{level}', '{name}', '{group}', 'earned', "
            f"{' + '.join(f'points[{i}]' for i in places)}, 'max', {len(places)}L)"
            for group, places in groups.items()
        ]
    return f"inline(array({', '.join(cells)}))"


def percentage(earned: Column, maximum: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(earned, maximum), 4), F.lit(0.0))


def roll_up(points: DataFrame) -> DataFrame:
    """Points per run by section, category and dimension, and in total; no exchange."""
    levels = [("section", 0), ("category", 3), ("dimension", 1), ("total", None)]
    return points.selectExpr("run_id", _sums(levels, "level", "name")).withColumn(
        "percentage", percentage(F.col("earned"), F.col("max"))
    )


# A worse status wins.
SEVERITY = {"passed": 0, "failed": 1, "error": 2}


def worst_status(status: Column) -> Column:
    """Aggregate: error before failed before passed."""
    rank = F.max(F.coalesce(*[F.when(status == s, F.lit(r)) for s, r in SEVERITY.items()]))
    return F.coalesce(*[F.when(rank == r, F.lit(s)) for s, r in SEVERITY.items()])


def task_status(sections: DataFrame, keys: list[str]) -> DataFrame:
    return sections.groupBy(*keys).agg(
        worst_status(F.col("status")).alias("status"), F.count("*").alias("sections")
    )


def batch_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks by status and pooled points; ``runs`` has status, earned and max."""
    summed = runs.groupBy(*keys).agg(
        F.count("*").alias("n_tasks"),
        *[F.count_if(F.col("status") == s).alias(f"n_{n}") for s, n in (("passed", "passed"), ("failed", "failed"), ("error", "errors"))],
        F.coalesce(F.sum("earned"), F.lit(0)).cast("bigint").alias("earned"),
        F.sum(F.coalesce("max", F.lit(MAX_POINTS))).cast("bigint").alias("max"),
    )
    return summed.withColumn("percentage", percentage(F.col("earned"), F.col("max"))).withColumn(
        "label", F.concat_ws("/", "earned", "max")
    )


def score_fallback(runs: DataFrame) -> DataFrame:
    """Points from the score fields, else from a label e/m, else a percentage of 1, else 0."""
    parts = F.split("label", "/")
    halves = F.size(parts) == 2
    labelled = F.when(halves, F.struct(
        F.get(parts, F.lit(0)).try_cast("double").alias("e"),
        F.get(parts, F.lit(1)).try_cast("double").alias("m"),
    ))
    has_fields = F.col("earned").isNotNull() & F.col("max").isNotNull()
    usable = labelled["e"].isNotNull() & labelled["m"].isNotNull()
    share = F.coalesce(F.col("percentage").try_cast("double"), F.lit(0.0))
    earned = F.when(has_fields, F.col("earned").cast("double")).when(usable, labelled["e"]).otherwise(share)
    maximum = F.when(has_fields, F.col("max").cast("double")).when(usable, labelled["m"]).otherwise(1.0)
    return runs.select(
        "run_id",
        earned.alias("earned"),
        maximum.alias("max"),
        F.bround(
            F.when(has_fields | usable, F.coalesce(F.try_divide(earned, maximum), F.lit(0.0))).otherwise(share), 4
        ).alias("percentage"),
    )


def observations(points: DataFrame) -> DataFrame:
    """Points per (file, run) for the file, every dimension, category and criterion.

    ``points`` has json_file and is made by ``run_points``; no exchange.
    """
    levels = [("file", None), ("dimension", 1), ("category", 3), ("criterion", -1)]
    rows = points.selectExpr("json_file", "run_id", _sums(levels, "section_type", "section"))
    return rows.withColumn("share", F.try_divide("earned", "max"))


def _pool(rows: DataFrame, keys: list[str], share: str) -> DataFrame:
    pooled = rows.groupBy(*keys).agg(
        F.sum("earned").cast("bigint").alias("earned"),
        F.sum("max").cast("bigint").alias("max"),
        F.count(share).alias("n_observations"),
        F.stddev_samp(share).alias("_std"),
    )
    return (
        pooled.withColumn("percentage", percentage(F.col("earned"), F.col("max")))
        .withColumn("ci95", mean_half_width(F.col("n_observations"), F.col("_std")))
        .drop("_std")
    )


def benchmark_aggregates(observed: DataFrame) -> DataFrame:
    """Pooled points, percentage and interval per file and section."""
    return _pool(observed, ["json_file", "section_type", "section"], "share")


def _stored_share() -> Column:
    """Section shares are stored with 4 decimals before they are used again, file shares are not."""
    return F.when(F.col("section_type") == "file", F.col("share")).otherwise(F.bround("share", 4))


def across_files(observed: DataFrame) -> DataFrame:
    """Pooled means over files with an interval over observations and one over files."""
    sections = observed.withColumn("_stored", _stored_share())
    keys = ["section_type", "section"]
    pooled = _pool(sections, keys, "_stored")
    per_file = benchmark_aggregates(observed)
    over_files = per_file.groupBy(*keys).agg(
        F.count("*").alias("n_json_files"),
        F.bround(F.avg("percentage"), 4).alias("macro_mean"),
        F.stddev_samp("percentage").alias("_std"),
    )
    return (
        pooled.join(over_files, keys)
        .withColumn("ci95_across_files", mean_half_width(F.col("n_json_files"), F.col("_std")))
        .drop("_std")
    )


def relabel(observed: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Replace file names by their display label; files without one keep their stem."""
    stem = F.regexp_replace("json_file", r"\.json$", "")
    mapped = F.coalesce(*[F.when(stem == k, F.lit(v)) for k, v in labels.items()], stem)
    return observed.withColumn("json_file", F.concat(mapped, F.lit(".json")))


def pooled_labels(observed: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Benchmark aggregates after files with one label are pooled."""
    stored = relabel(observed.withColumn("_stored", _stored_share()), labels)
    return _pool(stored, ["json_file", "section_type", "section"], "_stored")


def bounded_errors(rows: DataFrame) -> DataFrame:
    """Rows by percentage with error bars that stay within 0..1."""
    return rows.select(
        "*",
        F.least("ci95", "percentage").alias("error_low"),
        F.least(F.col("ci95"), 1 - F.col("percentage")).alias("error_high"),
    ).orderBy("percentage", "json_file")
