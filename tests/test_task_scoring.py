import os
import random
import time
from types import SimpleNamespace

import pytest

from voxtrace.operators import artifacts, runs, scoring, task_scoring, traces
from voxtrace.operators import volume as vol
from voxtrace.session import drop_staged, stage, staging_root

EVENTS = "run_id bigint, ts bigint, event_id bigint, route string"


def test_runs_without_events_and_skipped_sections(spark):
    run = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "run_id bigint, task_id int")
    specs = spark.createDataFrame(
        [(1, "a", ["b"], ["z"]), (2, None, [], [])],
        "task_id int, primary string, necessary array<string>, forbidden array<string>",
    )
    events = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b"), (1, 3, 3, "a")], EVENTS)
    rows = {r["run_id"]: r for r in task_scoring.score_routing(run, specs, events).collect()}
    assert rows[1]["status"] == "passed" and not rows[1]["a3_none_repeated"]
    assert rows[2]["status"] == "failed" and not rows[2]["a1_primary"] and not rows[2]["a4_required_present"]
    assert rows[3]["status"] == rows[4]["status"] == "skipped" and rows[4]["a1_primary"]


def test_tools_by_task(spark):
    run = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 2, 2), (4, 3, 0)], "run_id bigint, task_id int, sandbox_attempts int")
    specs = spark.createDataFrame(
        [(1, ["x"], [], ["x", "y"], False, None), (2, [], [], [], False, True), (3, [], [], ["y"], False, None)],
        "task_id int, expected array<string>, forbidden array<string>, sequence array<string>, exact_set boolean, "
        "requires_sandbox boolean",
    )
    calls = spark.createDataFrame(
        [(1, 1, 1, "main_graph_tool_x", True, True), (1, 2, 2, "y", None, True), (2, 1, 3, "y", True, True), (2, 2, 4, "x", True, True)],
        "run_id bigint, ts bigint, event_id bigint, tool string, success boolean, flagged boolean",
    )
    events = spark.createDataFrame([(3, 1, 1, task_scoring.SANDBOX_ROUTE)], EVENTS)
    rows = {r["run_id"]: r for r in task_scoring.score_tools(run, specs, calls, events).collect()}
    assert rows[1]["status"] == "passed" and rows[1]["unexpected_calls"] == 1
    assert rows[2]["c1_tools"] and not rows[2]["c2_order"]
    assert rows[3]["status"] == "failed" and rows[3]["unexpected_calls"] == 0  # too many attempts
    assert rows[4]["status"] == "failed"


def test_calls_without_any_flag_count(spark):
    run = spark.createDataFrame([(1, 1, 0)], "run_id bigint, task_id int, sandbox_attempts int")
    specs = spark.createDataFrame(
        [(1, ["x"], [], ["x"], False, None)],
        "task_id int, expected array<string>, forbidden array<string>, sequence array<string>, exact_set boolean, "
        "requires_sandbox boolean",
    )
    calls = spark.createDataFrame(
        [(1, 1, 1, "x", True, None)],
        "run_id bigint, ts bigint, event_id bigint, tool string, success boolean, flagged boolean",
    )
    row = task_scoring.score_tools(run, specs, calls, spark.createDataFrame([], EVENTS)).head()
    assert row["c1_tools"] and row["c2_order"] and row["status"] == "passed"


def follows(tools, sequence):
    at = 0
    for tool in tools:
        at += at < len(sequence) and tool == sequence[at]
    return at == len(sequence)


@pytest.mark.parametrize("parts", ["1", "7", "64"])
def test_sequences_over_slices(spark, parts):
    rng = random.Random(int(parts))
    calls, runs_ = [], []
    for run in range(40):
        tools = [rng.choice("abc") for _ in range(rng.choice([0, 3, 30, 400]))]
        calls += [(run, k // 3, k, t) for k, t in enumerate(tools)]
        sequence = [rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 12, 50]))]
        runs_.append((run, sequence, follows(tools, sequence)))
    rng.shuffle(calls)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = spark.createDataFrame([r[:2] for r in runs_], "run_id bigint, sequence array<string>")
        made = spark.createDataFrame(calls, "run_id bigint, ts bigint, event_id bigint, tool string")
        started = time.time()
        found = task_scoring.sequences_found(table, made)
        found._jdf.queryExecution().executedPlan()
        assert time.time() - started < 5
        got = {r["run_id"]: r["found"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {run: want for run, _, want in runs_}
    assert any(len(s) == 50 and w for _, s, w in runs_)


def test_a_broken_rule_fails_alone(spark):
    answers = spark.createDataFrame([(1, 1, "4"), (2, 1, "x"), (3, 2, None)], "id int, task_id int, k string")
    rules = spark.createDataFrame(
        [(1, "good", "k = '4'"), (1, "raises", "CAST(k AS INT) / (CAST(k AS INT) - 4) > 1"), (1, "number", "CAST(k AS INT) > 3"),
         (1, "broken", "(("), (1, "unknown", "nope > 1"), (2, "good", "k IS NULL"), (2, "none", None), (9, "other", "true")],
        "task_id int, rule string, text string",
    )
    rows = {(r["id"], r["rule"]): r for r in task_scoring.rules_by_task(answers, ["id"], rules).collect()}
    assert {k for k, r in rows.items() if r["passed"]} == {(1, "good"), (1, "number"), (3, "good")}
    assert {k for k, r in rows.items() if r["error"]} == {(i, n) for i in (1, 2) for n in ("broken", "unknown")} | {(3, "none")}
    assert len(rows) == 12 and spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_points_of_a_run_in_one_exchange(spark):
    run = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "run_id int, json_file string")
    scored = spark.createDataFrame(
        [(1, "A1_correct_primary_route", 1), (1, "C2_correct_tool_order", 1), (1, "C2_correct_tool_order", 0), (9, "B2_no_redundant_task", 1)],
        "run_id int, criterion_id string, earned int",
    )
    skipped = spark.createDataFrame([(2, "artifacts"), (2, "routing"), (8, "tools")], "run_id int, section string")
    points = scoring.run_points(run, scored, skipped, ["json_file"])
    got = {r["run_id"]: (r["json_file"], sum(r["points"])) for r in points.collect()}
    assert got == {1: ("f", 2), 2: ("f", 7), 3: ("g", 0)}
    # collected above, so that its own plan is a final one
    for df in (points.select("*"), scoring.roll_up(points), scoring.observations(points), scoring.criteria_of(points)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    levels = {(r["level"], r["name"]): (r["earned"], r["max"]) for r in scoring.roll_up(points).where("run_id = 2").collect()}
    assert levels["section", "routing"] == (4, 4) and levels["dimension", "D"] == (3, 3)
    assert levels["category", "Efficiency"] == (1, 3) and levels["total", "all"] == (7, 13) and len(levels) == 15


def test_artifacts_by_task(spark):
    run = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "run_id bigint, task_id int")
    specs = spark.createDataFrame(
        [(1, True, [([".csv"], 1)]), (2, False, []), (3, None, [])],
        "task_id int, requires boolean, groups array<struct<extensions:array<string>,min_count:int>>",
    )
    files = spark.createDataFrame([(1, "A.CSV", True)], "run_id bigint, path string, registered boolean")
    rows = {r["run_id"]: r for r in task_scoring.score_artifacts(run, specs, files).collect()}
    assert [rows[i]["status"] for i in (1, 2, 3, 4)] == ["passed", "failed", "passed", "skipped"]
    assert not rows[2]["d1_created"] and rows[3]["d1_created"]


def test_lineage_marks_cycles(spark):
    linked = spark.createDataFrame(
        [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "id string, parent string"
    )
    rows = {r["id"]: (r["root"], r["depth"]) for r in artifacts.lineage(linked).collect()}
    assert rows["c"] == ("a", 2) and rows["a"] == ("a", 0)
    assert rows["x"] == rows["y"] == rows["z"] == (None, None)


def test_unknown_success_is_neither(spark):
    events = spark.createDataFrame(
        [(1, 1, 1, "r", None), (1, 2, 2, "r", True), (1, 3, 3, "r", False)], EVENTS + ", success boolean"
    )
    row = traces.run_index(events).head()
    assert (row["tool_call_count"], row["successful_tool_calls"], row["failed_tool_calls"]) == (3, 1, 1)


def test_ties_round_to_even(spark):
    df = spark.createDataFrame([(1.0, 32.0), (3.0, 32.0)], "e double, m double")
    got = [r[0] for r in df.select(scoring.percentage(df["e"], df["m"])).collect()]
    assert got == [0.0312, 0.0938]


def test_modification_time_breaks_ties_of_a_batch(spark):
    tasks = spark.createDataFrame([(1,)], "task_id int")
    found = spark.createDataFrame(
        [(1, 7, 1, "run_completed", 9.0), (1, 8, 1, "run_failed", 3.0)],
        "task_id int, run_id int, batch_time int, completion string, modified double",
    )
    assert runs.latest_runs(tasks, found).head()["latest_run"] == 7
    assert runs.latest_runs(tasks, found.drop("modified")).head()["latest_run"] == 8


def test_bit_depth_without_a_slice_zero(spark):
    voxels = spark.createDataFrame([(1, 3, 0, 0, 5.0), (1, 3, 0, 1, 900.0), (1, 4, 0, 0, 0.0)], "volume_id int, z int, y int, x int, v double")
    row = vol.bit_depth(voxels, "v", "uint16").head()
    assert (row["dynamic_range"], row["bit_depth"]) == (895.0, 12)


def test_staged_tables_go(spark):
    kept = stage(spark.range(3), "gone")
    path = kept.inputFiles()[0]
    assert kept.count() == 3
    drop_staged(spark)
    assert not os.path.exists(path.removeprefix("file://")) and staging_root(spark)


def test_staging_without_a_preset_folder():
    def session(master):
        conf = SimpleNamespace(get=lambda key, default=None: default)
        context = SimpleNamespace(master=master, applicationId=f"test-{master}", getConf=lambda: conf)
        return SimpleNamespace(conf=conf, sparkContext=context)

    folder = staging_root(session("local[2]"))
    assert os.path.isdir(folder) and staging_root(session("local[2]")) == folder
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x:7077"):
        with pytest.raises(RuntimeError):
            staging_root(session(master))
