"""Run bookkeeping: latest run per task, completion rules, rerun planning, index refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.functions.text import matches_pattern

# The time at the end of a batch folder's name, and a run folder's name.
BATCH_TIME = r"_(\d{2}-\d{2}-\d{4}_\d{2}-\d{2}-\d{2})$"
BATCH_FORMAT = "dd-MM-yyyy_HH-mm-ss"
RUN_FOLDER = r"^\d+_(.+)_run-[0-9a-f]+$"


def batch_time(folder: Column) -> Column:
    """Time in a batch folder's name; null, and so before all others, if there is none."""
    found = F.regexp_extract(folder, BATCH_TIME, 1)
    return F.when(
        found != "", F.try_to_timestamp(found, F.lit(BATCH_FORMAT)).cast("timestamp_ntz")
    )


def task_of_folder(folder: Column) -> Column:
    found = F.regexp_extract(folder, RUN_FOLDER, 1)
    return F.when(found != "", found)


def completion_status(result: Column, has_summary: Column, has_judge: Column) -> Column:
    """From the result's status, else from the files that only a finished run leaves.

    ``result`` is null if there is no readable result; a readable result without a known
    status is an empty text or another word.
    """
    return (
        F.when(result.isin("passed", "failed"), "run_completed")
        .when(result == "error", "run_error")
        .when(result.isNull(), "run_error")
        .when(has_summary | has_judge, "run_completed")
        .otherwise("run_error")
    )


def judge_outcome(judge: Column) -> Column:
    return (
        F.when(judge == "passed", "judge_passed")
        .when(judge == "failed", "judge_failed")
        .otherwise("judge_unavailable")
    )


def indexed_status(result: Column, judge: Column) -> tuple[Column, Column, Column]:
    """Status of a run taken from the index: (rerun_status, completion, judge outcome).

    The index path calls every run completed; only with both verdicts does it count.
    """
    done = F.coalesce(result.isin("passed", "failed") & judge.isin("passed", "failed"), F.lit(False))
    outcome = (
        F.when(done & (result == "passed"), "judge_passed")
        .when(done, "judge_failed")
        .otherwise("judge_unavailable")
    )
    return F.when(done, "passed").otherwise("run_error"), F.lit("run_completed"), outcome


def latest_runs(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Per task the latest run and the latest completed one, by (batch time, modification time, run).

    ``runs`` has task_id, run_id, batch_time, completion and, if known, modified. Both are partial maxima, so a
    task with very many runs is reduced before the shuffle.
    """
    if "modified" not in runs.columns:
        runs = runs.withColumn("modified", F.lit(0.0))
    modified = F.coalesce("modified", F.lit(0).cast(runs.schema["modified"].dataType)).alias("modified")
    at = F.struct("batch_time", modified, "run_id")
    done = F.col("completion") == "run_completed"
    newest = runs.groupBy("task_id").agg(
        F.max(F.struct("batch_time", modified, "run_id", "completion")).alias("_latest"),
        F.max(F.when(done, at)).alias("_completed"),
        F.count("*").alias("present_runs"),
        F.count_if(done).alias("completed_runs"),
    )
    zero = F.lit(0).cast("bigint")
    return tasks.join(newest, "task_id", "left").select(
        *tasks.columns,
        F.col("_latest.run_id").alias("latest_run"),
        F.col("_completed.run_id").alias("latest_completed_run"),
        F.coalesce("_latest.completion", F.lit("missing_run")).alias("run_completion_status"),
        F.when(F.col("_latest.completion") == "run_completed", "passed")
        .otherwise(F.coalesce("_latest.completion", F.lit("missing_run")))
        .alias("rerun_status"),
        F.coalesce("present_runs", zero).alias("present_runs"),
        F.coalesce("completed_runs", zero).alias("completed_runs"),
    )


# The columns of a status row, and the fields of a task that may hold its variant's path.
STATUS_COLUMNS = (
    "rerun_status", "run_completion_status", "judge_outcome", "task_id", "source_task_id", "question",
    "variant_path", "latest_batch", "latest_run_folder", "latest_judge_status", "latest_result_status",
    "latest_judge_raw_score_1_to_5", "latest_judge_pass_threshold_1_to_5", "latest_result_score_label",
    "latest_result_score_percentage", "present_run_count", "completed_run_count", "latest_completed_batch",
    "latest_completed_run_folder", "proof", "latest_run_dir", "latest_completed_run_dir",
)
VARIANT_FIELDS = (
    "volume_relative_path", "dataset_relative_path", "volume_relative_path_variant", "dataset_relative_path_variant",
)


def _shown(value: Column, text: bool) -> Column:
    """A value as it stands in a proof: texts in quotes, numbers bare, a missing one as None."""
    if text:
        plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
        quoted = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
        value = F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(quoted)
    return F.coalesce(value.cast("string"), F.lit("None"))


def compact(text: Column, limit: int = 220) -> Column:
    """One line with single spaces, cut to ``limit`` characters with dots at the end; null is empty."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 3), F.lit("...")))


def run_proof(runs: DataFrame) -> Column:
    """What the two files of a run say, as one text."""
    texts = {f.name for f in runs.schema if f.dataType.typeName() == "string"}

    def part(label: str, column: str, always: bool = False) -> Column:
        shown = F.concat(F.lit(f"{label}="), _shown(F.col(column), column in texts))
        return shown if always else F.when(F.col(column).isNotNull(), shown)

    judge, result = "judge_response.json", "result.json"
    error = F.concat(
        F.coalesce("first_error.type", F.lit("error")), F.lit(": "), F.coalesce("first_error.message", F.lit(""))
    )
    judged = F.concat_ws(
        " | ",
        part(f"{judge}.status", "judge_status", True),
        part(f"{judge}.raw_score_1_to_5", "judge_score"),
        part(f"{judge}.pass_threshold_1_to_5", "judge_threshold"),
    )
    finished = F.concat_ws(
        " | ",
        part(f"{result}.status", "result_status", True),
        part(f"{result}.score.label", "score_label"),
        part(f"{result}.score.percentage", "score_percentage"),
        F.when(F.col("first_error").isNotNull(), F.concat(F.lit(f"{result}.errors[0]="), compact(error))),
    )
    return F.concat_ws(
        " | ",
        F.when(F.col("judge_error").isNull(), judged).otherwise(F.concat(F.lit(f"{judge}="), "judge_error")),
        F.when(F.col("result_error").isNull(), finished).otherwise(F.concat(F.lit(f"{result}="), "result_error")),
    )


def status_rows(tasks: DataFrame, runs: DataFrame, specification: str = "tasks") -> DataFrame:
    """One row per specified task: its latest run, its latest completed run, counts and the proof.

    ``tasks``: id and, if known, source_task_id, question and any of ``VARIANT_FIELDS``. ``runs``: task_id, batch,
    run_folder, run_dir, has_summary, judge_error and result_error (null if the file could be read, else "missing" or
    what is wrong), judge_status, judge_score, judge_threshold, result_status, score_label, score_percentage,
    first_error (type, message; null if there is none) and, if known, modified. Values of a file that could
    not be read count as missing; runs without a task take no part; missing values are empty texts.

    Runs are reduced by partial maxima of (batch time, modification time, folder), so neither a task with
    very many runs nor their texts are gathered: the texts of a run travel with a maximum of each task only.
    """
    of_file = {
        "judge_error": ("judge_status", "judge_score", "judge_threshold"),
        "result_error": ("result_status", "score_label", "score_percentage", "first_error"),
    }
    for error, columns in of_file.items():
        runs = runs.withColumns({c: F.when(F.col(error).isNull(), F.col(c)) for c in columns})
    modified = F.col("modified") if "modified" in runs.columns else F.lit(0.0)
    readable = F.when(F.col("result_error").isNull(), F.coalesce("result_status", F.lit("")))
    judge_file = F.coalesce(F.col("judge_error") != "missing", F.lit(True))
    completion = completion_status(readable, F.coalesce("has_summary", F.lit(False)), judge_file)
    records = runs.where(F.coalesce("task_id", F.lit("")) != "").select(
        "task_id",
        completion.alias("completion"),
        F.struct(
            batch_time(F.col("batch")).alias("at"), F.coalesce(modified.cast("double"), F.lit(0.0)).alias("modified"),
            "run_folder", "run_dir", "batch",
        ).alias("place"),
        F.struct(
            judge_outcome(F.col("judge_status")).alias("outcome"), "judge_status", "result_status",
            F.col("judge_score").cast("string").alias("judge_score"),
            F.col("judge_threshold").cast("string").alias("judge_threshold"),
            "score_label", F.col("score_percentage").cast("string").alias("score_percentage"),
            run_proof(runs).alias("proof"), completion.alias("completion"),
        ).alias("facts"),
    )
    done = F.col("completion") == "run_completed"
    newest = records.groupBy("task_id").agg(
        F.max(F.struct("place", "facts")).alias("_last"),
        F.max(F.when(done, F.col("place"))).alias("_done"),
        F.count("*").alias("_present"),
        F.count_if(done).alias("_completed"),
    )

    def given(column: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(column).cast("string"), otherwise) if column in tasks.columns else otherwise

    empty = F.lit("")
    variants = [
        F.col(c) for c in VARIANT_FIELDS if c in tasks.columns and tasks.schema[c].dataType.typeName() == "string"
    ]
    wanted = tasks.select(
        F.col("id").cast("string").alias("task_id"),
        given("source_task_id", F.col("id").cast("string")).alias("source_task_id"),
        given("question", empty).alias("question"),
        F.coalesce(*variants, empty).alias("variant_path"),
    )
    found, missing = F.col("_last.facts"), F.lit("missing_run")
    last, completed = F.col("_last.place"), F.col("_done")
    none = F.lit(f"No present run folder matched this expanded {specification}.json task_id.")
    completion = found["completion"]
    values = {
        "rerun_status": F.when(completion == "run_completed", "passed").otherwise(F.coalesce(completion, missing)),
        "run_completion_status": F.coalesce(completion, missing),
        "judge_outcome": F.coalesce(found["outcome"], F.lit("judge_unavailable")),
        "latest_batch": last["batch"],
        "latest_run_folder": last["run_folder"],
        "latest_judge_status": found["judge_status"],
        "latest_result_status": found["result_status"],
        "latest_judge_raw_score_1_to_5": found["judge_score"],
        "latest_judge_pass_threshold_1_to_5": found["judge_threshold"],
        "latest_result_score_label": found["score_label"],
        "latest_result_score_percentage": found["score_percentage"],
        "present_run_count": F.coalesce("_present", F.lit(0).cast("bigint")),
        "completed_run_count": F.coalesce("_completed", F.lit(0).cast("bigint")),
        "latest_completed_batch": completed["batch"],
        "latest_completed_run_folder": completed["run_folder"],
        "proof": F.coalesce(found["proof"], none),
        "latest_run_dir": last["run_dir"],
        "latest_completed_run_dir": completed["run_dir"],
    }
    counts = ("present_run_count", "completed_run_count")
    return wanted.join(newest, "task_id", "left").select(
        *[
            (values[c] if c in counts else F.coalesce(values.get(c, F.col(c)), empty)).alias(c)
            for c in STATUS_COLUMNS
        ]
    )


def status_pivot(latest: DataFrame, source: str) -> DataFrame:
    """passed, run_error, missing_run and total per source."""
    names = ["passed", "run_error", "missing_run"]
    zero = F.lit(0).cast("bigint")
    counts = latest.groupBy(source).pivot("rerun_status", names).count()
    filled = [F.coalesce(n, zero).alias(n) for n in names]
    total = sum((F.coalesce(F.col(n), zero) for n in names), zero)
    return counts.select(source, *filled, total.alias("total"))


def merge_index(index: DataFrame, specified: DataFrame) -> DataFrame:
    """Existing index rows as they are, plus specified tasks that are not in it yet."""
    new = specified.join(index.select("task_id"), "task_id", "left_anti").select(
        "task_id", F.lit(True).alias("run_requested"), F.lit(None).cast("string").alias("path")
    )
    return index.select("task_id", "run_requested", "path").unionByName(new)


def plan_runs(
    index: DataFrame,
    specified: DataFrame,
    existing_paths: DataFrame,
    requested_only: bool = False,
    allowed: Sequence[str] | None = None,
) -> DataFrame:
    """Tasks to run: the requested ones, or those not declined whose path does not exist."""
    rows = merge_index(index, specified).join(
        specified.select("task_id").distinct(), "task_id", "left_semi"
    )
    if allowed is not None:
        rows = rows.where(F.col("task_id").isin(list(allowed)))
    wanted = F.coalesce("run_requested", F.lit(True))
    if requested_only:
        return rows.where(wanted).select("task_id")
    found = existing_paths.select("path").distinct().withColumn("_exists", F.lit(True))
    return (
        rows.where(wanted)
        .join(found, "path", "left")
        .where(F.col("_exists").isNull())
        .select("task_id")
    )


def refresh_index(index: DataFrame, found: DataFrame) -> DataFrame:
    """Latest folder per task (by batch, then folder name) sets the path and ends the request."""
    newest = found.groupBy("task_id").agg(F.max(F.struct("batch", "folder", "path")).alias("_new"))
    return index.join(newest, "task_id", "left").select(
        "task_id",
        F.when(F.col("_new").isNotNull(), False).otherwise(F.col("run_requested")).alias("run_requested"),
        F.coalesce("_new.path", "path").alias("path"),
    )


def apply_results(index: DataFrame, results: DataFrame) -> DataFrame:
    """Completed results set the path, if they have one, and end the request."""
    done = (
        results.where(F.col("status").isin("passed", "failed"))
        .groupBy("task_id")
        .agg(F.max_by("path", "position").alias("_path"))
        .withColumn("_done", F.lit(True))
    )
    return index.join(done, "task_id", "left").select(
        "task_id",
        F.when(F.col("_done"), False).otherwise(F.col("run_requested")).alias("run_requested"),
        F.coalesce("_path", "path").alias("path"),
    )


def select_runs(
    rows: DataFrame,
    exact: Sequence[str] = (),
    run_patterns: Sequence[str] = (),
    run_regexes: Sequence[str] = (),
    task_patterns: Sequence[str] = (),
    benchmark_patterns: Sequence[str] = (),
) -> DataFrame:
    """Rows that any selector picks; ``rows`` has run_id, task_id and benchmark."""
    chosen = (
        F.col("run_id").isin(list(exact))
        | matches_pattern(F.col("run_id"), run_patterns)
        | matches_pattern(F.col("task_id"), task_patterns)
        | matches_pattern(F.col("benchmark"), benchmark_patterns)
    )
    for pattern in run_regexes:
        chosen = chosen | F.col("run_id").rlike(pattern)
    return rows.where(chosen)
