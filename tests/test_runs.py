"""Status rows of specified tasks."""

from voxtrace.operators import runs as run_ops

RUNS = """task_id string, batch string, run_folder string, run_dir string, modified double, has_summary boolean,
  judge_error string, judge_status string, judge_score double, judge_threshold int, result_error string,
  result_status string, score_label string, score_percentage double, first_error struct<type string, message string>"""


def rows_of(spark, runs, tasks=None):
    tasks = tasks or [("a", "s", "why?", None, "d"), ("b", None, None, "v", "d"), ("c", None, None, None, None)]
    given = spark.createDataFrame(
        tasks, "id string, source_task_id string, question string, volume_relative_path string, dataset_relative_path string"
    )
    found = run_ops.status_rows(given, spark.createDataFrame(runs, RUNS))
    assert tuple(found.columns) == run_ops.STATUS_COLUMNS
    return {r["task_id"]: r for r in found.collect()}


def test_status_rows(spark):
    new, old = "x_02-01-2024_10-00-00", "x_31-12-2023_10-00-00"
    runs = [
        ("a", new, "1_a", "r/1", 1.0, True, None, "failed", 2.5, 4, None, "error", None, None, (None, "line\n one" + "!" * 300)),
        ("a", old, "9_a", "r/9", 9.0, False, None, "passed", None, None, None, "passed", "it's", 0.5, None),
        ("a", "no time", "8_a", "r/8", 99.0, True, "missing", None, None, None, None, "passed", None, None, None),
        # two of one time: the later modified one, whatever its name; an unreadable file says nothing
        ("b", new, "1_b", "r/1b", 5.0, True, "missing", "passed", 5.0, 4, "invalid_json: x", "passed", "9/13", 1.0, ("E", "m")),
        ("b", new, "2_b", "r/2b", 4.0, False, "not_object: list", None, None, None, None, None, None, None, None),
        (None, new, "3", "r/3", 4.0, True, None, "passed", None, None, None, "passed", None, None, None),
        ("", new, "4", "r/4", 4.0, True, None, "passed", None, None, None, "passed", None, None, None),
        ("zz", new, "5", "r/5", 4.0, True, None, "passed", None, None, None, "passed", None, None, None),
    ]
    rows = rows_of(spark, runs)
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert set(rows) == {"a", "b", "c"}
    assert (a["rerun_status"], a["run_completion_status"], a["judge_outcome"]) == ("run_error", "run_error", "judge_failed")
    assert (a["latest_run_folder"], a["latest_completed_run_folder"], a["latest_completed_run_dir"]) == ("1_a", "9_a", "r/9")
    assert (a["present_run_count"], a["completed_run_count"]) == (3, 2)
    assert (a["source_task_id"], a["question"], a["variant_path"]) == ("s", "why?", "d")
    error = "error: line one" + "!" * 300
    assert a["proof"] == (
        "judge_response.json.status='failed' | judge_response.json.raw_score_1_to_5=2.5"
        " | judge_response.json.pass_threshold_1_to_5=4 | result.json.status='error' | result.json.errors[0]=" + error[:217] + "..."
    )
    assert (b["latest_run_folder"], b["run_completion_status"], b["judge_outcome"]) == ("1_b", "run_error", "judge_unavailable")
    assert b["proof"] == "judge_response.json=missing | result.json=invalid_json: x"
    assert (b["latest_judge_status"], b["latest_result_status"], b["latest_result_score_label"]) == ("", "", "")
    # without a known status a judge file of any kind tells a finished run
    assert (b["latest_completed_run_folder"], b["completed_run_count"]) == ("2_b", 1)
    assert (b["variant_path"], b["source_task_id"], b["question"]) == ("v", "b", "")
    assert (c["rerun_status"], c["judge_outcome"], c["present_run_count"], c["latest_batch"]) == ("missing_run", "judge_unavailable", 0, "")
    assert c["proof"] == "No present run folder matched this expanded tasks.json task_id."


def test_status_rows_of_texts_with_quotes_and_of_no_runs(spark):
    new = "x_02-01-2024_10-00-00"
    run = ("a", new, "1", "r", 1.0, True, None, None, None, None, None, "it's", "x\\y", None, None)
    assert rows_of(spark, [run])["a"]["proof"] == (
        "judge_response.json.status=None | result.json.status=\"it's\" | result.json.score.label='x\\\\y'"
    )
    assert {r["rerun_status"] for r in rows_of(spark, []).values()} == {"missing_run"}
