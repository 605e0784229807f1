"""Trace, task, text, score and source rules on hand-made input."""

import gzip
import json
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtrace.functions import payload, predicates, text
from voxtrace.operators import artifacts as art
from voxtrace.operators import runs as run_ops
from voxtrace.operators import run_lines, scoring, tasks, traces
from voxtrace.sources import catalog, json_docs, library, nifti
from voxtrace.streaming import rollup

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (run, minute, event_id, route, success)."""
    data = [(r, T0 + timedelta(minutes=m), e, route, ok) for r, m, e, route, ok in rows]
    return spark.createDataFrame(
        data, "run_id bigint, ts timestamp_ntz, event_id bigint, route string, success boolean"
    )


def test_route_checks(spark):
    df = events(spark, [(1, 0, 1, "a", True), (1, 1, 2, "b", True), (1, 2, 3, "a", True), (2, 0, 4, "x", True)])
    rows = {r["run_id"]: r for r in traces.route_checks(df, "a", ["a", "b"], ["x"]).collect()}
    assert rows[1]["status"] == "passed" and not rows[1]["a3_none_repeated"] and rows[1]["repeated_routes"] == "a"
    assert rows[2]["status"] == "failed" and not rows[2]["a2_none_forbidden"] and rows[2]["a3_none_repeated"]


def test_in_order_matches_a_scan(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 5)), int(rng.integers(0, 50)), i, "abc"[rng.integers(0, 3)], True) for i in range(80)]
    df = events(spark, rows)
    needle = ["a", "a", "c", "b", "a", "c"]
    got = {r["run_id"]: r["found"] for r in traces.in_order(df, df, "route", needle).collect()}
    for run in got:
        items = iter(r[3] for r in sorted((x for x in rows if x[0] == run), key=lambda x: (x[1], x[2])))
        assert got[run] == all(any(i == n for i in items) for n in needle)
    assert all(r["found"] for r in traces.in_order(df, df, "route", []).collect())


def test_tools_flag_rule_and_prefix(spark):
    df = spark.createDataFrame(
        [
            (1, T0, 1, "main_graph_tool_a", True, True), (1, T0, 2, "b", None, False), (1, T0, 3, "create_session", True, True),
            (2, T0, 4, " a ", None, False), (2, T0, 5, "b", None, False), (3, T0, 6, "a", False, True),
        ],
        "run_id bigint, ts timestamp_ntz, event_id bigint, tool string, success boolean, flagged boolean",
    )
    rows = {r["run_id"]: r for r in traces.tool_checks(df, ["a"], ["b"], ["a"], exact_set=True, requires_sandbox=False).collect()}
    assert rows[1]["c1_tools"] and rows[1]["status"] == "passed"  # the unflagged b does not count
    assert not rows[2]["c1_tools"] and rows[2]["forbidden_calls"] == 1 and rows[2]["c2_order"]
    assert not rows[3]["c1_tools"] and not rows[3]["c2_order"] and rows[3]["c3_sandbox"]


def test_intervals_boundary_and_fallback(spark):
    def part(rows):
        data = [(r, T0 + timedelta(minutes=m), e, k, ok, t) for r, m, e, k, ok, t in rows]
        return spark.createDataFrame(
            data, "run_id bigint, ts timestamp_ntz, event_id bigint, key string, success boolean, tool string"
        )

    routes = part([(1, 0, 1, "a", True, ""), (1, 10, 2, "b", True, ""), (1, 20, 3, "a", True, "")])
    tools = part([(1, 0, 10, "a", True, "t1"), (1, 10, 11, "a", True, "t2"), (1, 10, 12, "b", False, "t3"), (1, 25, 13, "b", True, "t4")])
    got = {r["event_id"]: r["route_event_id"] for r in traces.assign_to_routes(routes, tools).collect()}
    assert got == {10: 1, 11: None, 12: 2, 13: None}
    subs = {r["event_id"]: r for r in traces.sub_runs(routes, tools).collect()}
    assert (subs[1]["tool_names"], subs[1]["status"], subs[1]["call_index"]) == ("t1", "completed", 1)
    assert subs[2]["status"] == "failed" and subs[2]["tool_events"] == 1
    assert subs[3]["assigned_by"] == "key" and subs[3]["tool_names"] == "t1,t2" and subs[3]["call_index"] == 2
    alone = traces.sub_runs(routes, tools.where("false")).collect()
    assert all(r["tool_events"] == 0 and r["status"] == "completed" for r in alone)


def test_long_run_is_split_into_segments(spark):
    df = spark.range(2500).select(
        F.lit(1).cast("bigint").alias("run_id"), F.col("id").alias("event_id"),
        F.lit(T0).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("r"), F.col("id")).alias("route"),
    )
    rows = traces.ordered_routes(df).orderBy("segment").collect()
    assert [r["routes"] for r in rows] == [1000, 1000, 500]
    assert ",".join(r["route_list"] for r in rows) == ",".join(f"r{i}" for i in range(2500))


def test_messages(spark):
    df = spark.createDataFrame(
        [(1, 0, "human", "hi"), (1, 1, "AIMessage", "a"), (1, 2, "assistant", "b"), (1, 3, "tool", "c")],
        "run_id int, turn int, type string, text string",
    )
    assert traces.last_assistant_message(df).head()["text"] == "b"
    assert traces.token_estimate(df, 1).head()["tokens"] == 2
    split = traces.split_messages(df.where("turn < 2"), df.where("turn in (0, 3)"))
    assert sorted((r["turn"], r["visibility"]) for r in split.collect()) == [(0, "visible"), (1, "visible"), (3, "internal")]


def test_artifact_requirement(spark):
    files = spark.createDataFrame([(1, "A.TIF", True), (1, "b.csv", False)], "run_id int, path string, registered boolean")
    row = traces.artifact_checks(files, [([".tif"], 1), ([".csv"], 1)]).head()
    assert row["d2_types"] and not row["d3_registered"] and row["status"] == "failed"
    assert traces.artifact_checks(files, [([".zip"], 1)], required=False).head()["status"] == "passed"


def test_answers(spark):
    cases = {
        '{"a": 1}': "dict", "[1]": "list", "3": "number", "true": "bool", "None": "null", "": "text",
        "x {'a': 1} y": "dict", "see [1, 2] and {\"b\": \"}\"}": "dict", "only [1, {\"a\": 2}]": "dict",
        "{broken [3]": "list", "plain": "text", '"quoted"': "text", "('a', 1)": "text",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["a"] for r in df.select("t", tasks.parse_answer(F.col("t")).alias("a")).collect()}
    assert {k: v["kind"] for k, v in got.items()} == cases
    assert json.loads(got['see [1, 2] and {"b": "}"}']["json"]) == {"b": "}"}


def test_bracket_spans_take_one_pass():
    text = "it's [don't {\"a\": 1} won't] {'b': ']'} [1, (2)] {x"
    spans = [text[a:b] for a, b in tasks.bracket_spans(text, '"')]
    assert spans[:2] == ["[don't {\"a\": 1} won't]", '{"a": 1}']
    assert tasks.find_answer(text) == ({"b": "]"},)
    assert tasks.find_answer("don't [use 'this'] {\"k\": 3}") == ({"k": 3},)
    assert tasks.find_answer("[" * 50_000 + " {'k': 1}") == ({"k": 1},)
    assert tasks.find_answer("{'open [1, 2") == ()


def test_task_validation_and_expansion(spark):
    sections = {k: {} for k in tasks.EVALUATION_KEYS}
    docs = [
        json.dumps({"id": "t", "evaluation": sections}), json.dumps({"id": "t", "evaluation": sections}), "[", "3",
        json.dumps({"id": "u", "evaluation": []}), json.dumps({"id": "v", "evaluation": {}}),
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    errors = [r["error"] for r in tasks.validate_tasks(df, "i", "doc").orderBy("i").collect()]
    assert errors[:4] == [None, "duplicate task id", "must be a JSON object", "must be a JSON object"]
    assert errors[4] == "must contain an evaluation object" and errors[5].startswith("missing: dimension_A")
    one = spark.createDataFrame([("t", ["a/x_original.nii.gz", " a/x_original.nii.gz"])], "task_id string, f array<string>")
    assert [r["task_id"] for r in tasks.expand_field(one, "f", text.path_slug).collect()] == ["t"]
    blank = spark.createDataFrame([("t", ["a", " "])], "task_id string, f array<string>")
    with pytest.raises(Exception, match="non-empty"):
        tasks.expand_field(blank, "f", text.slug).collect()


def test_text_rules(spark):
    def value(column):
        return spark.range(1).select(column).head()[0]

    assert value(text.slug(F.lit(" ?? "))) == "patient" and value(text.slug(F.lit("-a b/c."))) == "a_b_c"
    assert value(text.dataset_slug(F.lit("d/c1/group_2/"))) == "c1_group_2"
    assert value(text.truncate(F.lit("x" * 1800))) == "x" * 1800
    assert value(text.truncate(F.lit("x" * 1803))).endswith("x... [truncated 3 chars]")
    row = spark.createDataFrame([("{b}", "{c}", "end")], "a string, b string, c string")
    assert row.select(text.render(F.lit("{a} {zz} {b}"), ["a", "b", "c"])).head()[0] == "end {zz} end"
    names = spark.createDataFrame([("run_a1",), ("run_b[1]",), ("other",)], "n string")
    def chosen(*p):
        return [r["n"] for r in names.where(text.matches_pattern(F.col("n"), p)).collect()]

    assert chosen("run_?1") == ["run_a1"] and chosen("b[[]1]") == [] and chosen("*[[]*") == ["run_b[1]"]
    assert chosen("the") == ["other"] and chosen("*_[!b]*") == ["run_a1"]


def test_predicates(spark):
    texts = ["1", "0", "1.5", "true", '"a"', "{}", "[1, 2]", "[1, true]", "null"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.try_parse_json("t"))
    checks = [predicates.is_int, predicates.is_positive_int, predicates.is_finite_number, predicates.is_bool,
              predicates.is_dict, predicates.is_int_list, predicates.is_string]
    got = [[r[0] for r in df.where(c(F.col("v"))).select("t").collect()] for c in checks]
    assert got == [["1", "0"], ["1"], ["1", "0", "1.5"], ["true"], ["{}"], ["[1, 2]"], ['"a"']]
    ranged = spark.createDataFrame([("null",), (None,), ("5",), ("11",), ("x",), ("nan",)], "t string")
    flags = [r[0] for r in ranged.select(predicates.number_or_none_in_range(F.col("t"), 0, 10)).collect()]
    assert flags == [True, True, True, False, False, False]


def test_rules_never_raise(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "id int, k int")
    got = tasks.evaluate_rules(df, ["id"], {"a": "k = 0", "b": "try_divide(1, k) > 0", "c": "nope > 1", "d": "(("})
    assert [r["passed"] for r in got.where("id = 1").collect()] == [True, False, False, False]
    assert tasks.final_answer_points(got, ["id"]).where("correct").count() == 0


def test_scores(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    scored = spark.createDataFrame([(1, "A1_correct_primary_route", 1), (1, "zz", 1)], "run_id int, criterion_id string, earned int")
    skipped = spark.createDataFrame([(2, "tools")], "run_id int, section string")
    total = scoring.roll_up(scoring.run_points(runs, scored, skipped)).where("level = 'total'")
    got = {r["run_id"]: (r["earned"], r["max"], r["percentage"]) for r in total.collect()}
    assert got == {1: (1, 13, 0.0769), 2: (3, 13, 0.2308)}
    status = spark.createDataFrame([("passed",), ("error",), ("failed",)], "status string")
    assert status.agg(scoring.worst_status(F.col("status"))).head()[0] == "error"
    rows = spark.createDataFrame([(1, None, None, "3/4", None), (2, None, None, "x/4", "0.5"), (3, 2, 8, "1/1", None), (4, None, 1, "", "x")],
                                 "run_id int, earned int, max int, label string, percentage string")
    got = [tuple(r)[1:] for r in scoring.score_fallback(rows).orderBy("run_id").collect()]
    assert got == [(3.0, 4.0, 0.75), (0.5, 1.0, 0.5), (2.0, 8.0, 0.25), (0.0, 1.0, 0.0)]


def test_run_without_batch_time_is_oldest(spark):
    folders = spark.createDataFrame([("b_02-01-2024_00-00-00",), ("b",), ("b_31-12-2023_23-59-59",)], "f string")
    times = [r[0] for r in folders.select(run_ops.batch_time(F.col("f"))).collect()]
    assert times == [datetime(2024, 1, 2), None, datetime(2023, 12, 31, 23, 59, 59)]
    runs = folders.select(
        F.lit(1).alias("task_id"), F.col("f").alias("run_id"), run_ops.batch_time(F.col("f")).alias("batch_time"),
        F.when(F.col("f").contains("2024"), "run_error").otherwise("run_completed").alias("completion"),
    )
    known = spark.createDataFrame([(1,), (2,)], "task_id int")
    rows = {r["task_id"]: r for r in run_ops.latest_runs(known, runs).collect()}
    assert rows[1]["latest_run"].endswith("00-00-00") and rows[1]["latest_completed_run"].endswith("59-59")
    assert rows[1]["rerun_status"] == "run_error" and rows[2]["rerun_status"] == "missing_run"


def test_registry_and_lineage(spark):
    schema = "id string, origin_path string, path string, value int, position int"
    left = spark.createDataFrame([("a", None, "p", 1, 0), (None, "o", "p", 2, 1), (None, "", None, 3, 2)], schema)
    right = spark.createDataFrame([("a", None, "q", 10, 0), (None, None, "p", 20, 1)], schema)
    rows = art.merge_registries(left, right).orderBy("side", "position").collect()
    assert [(r["key"], r["value"]) for r in rows] == [("id:a", 10), ("origin:o", 2), (None, 3), ("path:p", 20)]
    chain = spark.createDataFrame([(i, f"p{i}", f"p{i - 1}") for i in range(40)], "id bigint, path string, input_path string")
    got = {r["id"]: (r["root"], r["depth"]) for r in art.lineage(art.link_parents(chain)).collect()}
    assert got == {i: (0, i) for i in range(40)}


def test_stream_equals_batch(spark, tmp_path):
    df = events(spark, [(i % 3, i, i, "r", i % 4 != 0) for i in range(30)]).withColumn("args", F.lit("{}"))
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    batch = traces.run_index(df)
    for part in (df.where("event_id < 10"), df.where("event_id >= 10")):
        part.write.mode("append").json(source)
        rollup.keep_index(rollup.read_event_stream(spark, source), target, progress).awaitTermination()
    got = rollup.latest_index(spark, target)
    assert sorted(got.select(batch.columns).collect()) == sorted(batch.collect())


def test_stretches_of_batches():
    for fanout in (2, 8):
        written, most = [], 0
        for number in range(1000):
            live, covered = rollup.split_covered(written)
            written = [s for s in written if s not in [c for c, end in covered if end < number]]
            written.append((number, number))
            whole = rollup.stretch_after(number, fanout)
            written += [whole] if whole else []
            live, _ = rollup.split_covered(written)
            assert [n for a, b in live for n in range(a, b + 1)] == list(range(number + 1))
            most = max(most, len(live))
        assert most <= (fanout - 1) * (10 if fanout == 2 else 4)
        assert len(written) < 3 * fanout + most


def test_index_of_many_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [
        (int(rng.integers(0, 4)) or None, int(rng.integers(0, 90)), i, "abc"[i % 3], [True, False, None][i % 7 % 3])
        for i in range(70)
    ]
    df = events(spark, rows).coalesce(1)
    target = str(tmp_path / "index")
    assert rollup.latest_index(spark, target).count() == 0
    for number in range(7):  # late events: order of arrival is not that of time
        rollup.add_batch(df.where(F.col("event_id") % 7 == number), target, number, 2)
        if number in (3, 6):  # a batch repeated after a failure
            rollup.add_batch(df.where(F.col("event_id") % 7 == number), target, number, 2)
    assert rollup.split_covered(rollup.written_stretches(spark, target))[0] == [(0, 3), (4, 5), (6, 6)]
    want = traces.run_index(df)
    got = rollup.latest_index(spark, target).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # a folder that was not written to its end is not read
    (tmp_path / "index" / "batches-0-6").mkdir()
    assert got.count() == rollup.latest_index(spark, target).count()


def test_run_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(traces, "SEGMENT", 3)
    odd = ['a"b', "x\ny", "é, ]", None, "a"]
    rows = [(1, i, i, odd[i % 5], i % 2 == 0) for i in range(11)] + [(2, 0, 20, "z", None), (5, 1, 21, "q", False)]
    sessions = spark.createDataFrame(
        [(1, " T 1/b ", "s1", "/s/1"), (2, "  ", "", None), (3, "n" * 130, "s3", "/s/3")],
        "run_id bigint, test_name string, session_id string, session_path string",
    )
    df = events(spark, rows).repartition(5).withColumn("session_id", F.lit("not this one"))
    folder = str(tmp_path / "lines")
    run_lines.write_lines(run_lines.line_parts(df, sessions, "base"), folder)
    text = "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*")))
    lines = {d["run_id"]: d for d in map(json.loads, filter(str.strip, text.split("\n")))}
    assert sorted(lines) == [1, 2, 3, 5]
    one = lines[1]
    assert one["routes"] == [odd[i % 5] for i in range(11)]
    assert (one["test_name"], one["run_file"]) == ("T_1_b", "base/T_1_b/s1/1.json")
    assert (one["tool_call_count"], one["successful_tool_calls"], one["failed_tool_calls"]) == (11, 6, 5)
    assert one["started_at_unix"] == 1704067200.0 and one["ended_at"] == "2024-01-01T00:10:00.000000"
    assert lines[2]["run_file"] == "base/_ungrouped/no_session/2.json" and lines[2]["failed_tool_calls"] == 0
    assert lines[3]["routes"] == [] and lines[3]["started_at"] is None and len(lines[3]["test_name"]) == 120
    assert lines[5]["session_id"] is None and lines[5]["routes"] == ["q"]
    back = {r["run_id"]: r for r in run_lines.read_lines(spark, folder).collect()}
    assert back[1]["routes"] == one["routes"] and set(back) == set(lines)
    # a second run appends, an empty table adds nothing
    run_lines.write_lines(run_lines.line_parts(df.limit(0), sessions.limit(0), "base"), folder)
    run_lines.write_lines(run_lines.line_parts(df.where("run_id = 5"), sessions.limit(0), "base"), folder)
    assert run_lines.read_lines(spark, folder).count() == 5


def test_reduced_payload(spark):
    tree = {"name": "r", "path": "/r", "type": "directory", "children": [
        {"type": "file"}, 3, {"type": "symlink", "children": [{"type": "file"}]}, {"type": ["odd"]}]}
    wide = {f"k{i}": i for i in range(80)}
    deep = {"a": [{"b": "x" * 1805}] * 26, "tree_struct": tree, "n": None, "f": 1.5, "t": True}
    cases = {
        "deep": deep, "wide": wide | {"z": 1, "y": 2}, "fits": wide, "edge": wide | {"tree_struct": tree},
        "tree": {"tree_struct": [tree]}, "list": [], "text": "é" * 1801, "beyond": wide | {"z": 1, "tree_struct": tree},
    }
    texts = [(k, json.dumps(v)) for k, v in cases.items()]
    texts += [("null", None), ("bad", "{" * 1900), ("nested", "[" * 50000 + "]" * 50000), ("empty", "")]
    df = spark.createDataFrame(texts, "name string, payload string")
    got = {r["name"]: r["p"] for r in df.select("name", payload.reduce_payload(F.col("payload")).alias("p")).collect()}
    small = {k: json.loads(got[k]) for k in cases}
    counts = {"summary": payload.TREE_NOTE, "root_name": "r", "root_path": "/r", "file_count": 2, "directory_count": 2}
    item = {"b": "x" * 1800 + "... [truncated 5 chars]"}
    assert small["deep"] == {"a": [item] * 24 + [{"omitted_items": 2}], "tree_struct": counts, "n": None, "f": 1.5, "t": True}
    assert small["wide"] == wide | {"omitted_keys": 2} and small["fits"] == wide
    assert small["edge"] == wide | {"tree_struct": counts} and small["beyond"] == wide | {"omitted_keys": 2}
    assert small["tree"] == {"tree_struct": {"summary": payload.NO_TREE_NOTE}} and small["list"] == []
    assert small["text"] == "é" * 1800 + "... [truncated 1 chars]"
    assert got["null"] is None and got["empty"] == "" and got["bad"] == "{" * 1800 + "... [truncated 100 chars]"
    assert got["nested"] == "[" * 1800 + "... [truncated 98200 chars]"
    said = spark.createDataFrame([(1, "y" * 2401), (2, None)], "turn int, text string")
    assert [r["text"] for r in payload.reduce_messages(said).sort("turn").collect()] == ["y" * 2400 + "... [truncated 1 chars]", None]


def test_json_status(spark, tmp_path):
    cases = {'{"a": 1}': "ok", "[1]": "not_object", '{"a": 1},': "invalid_json", "nope": "invalid_json", '{"a": 1} {"b": 2}': "invalid_json"}
    for i, t in enumerate(cases):
        (tmp_path / f"{i}.json").write_text(t)
    got = json_docs.read_json_documents(spark, str(tmp_path)).collect()
    assert {r["text"]: r["status"] for r in got} == cases


def test_catalogue_rules(spark, tmp_path):
    for name in ("a1.tif", "a2.tif", "a3.tif", "a5.tif", "b.nii.gz"):
        (tmp_path / name).write_bytes(b"x" * 10)
    files = catalog.list_files(spark, str(tmp_path))
    assert catalog.file_inventory(files, ["nii.gz"]).head()["bytes"] == 10
    assert catalog.inventory_totals(files, None, 3).head()["truncated"]
    names = files.select(F.lit("f").alias("g"), catalog.base_name(F.col("path")).alias("n"))
    runs = {r["first_name"]: (r["last_name"], r["files"], r["folded"]) for r in catalog.numbered_runs(names, "g", "n").collect()}
    assert runs["a1.tif"] == ("a3.tif", 3, True) and runs["a5.tif"][2] is False
    mixed = spark.createDataFrame([("f", "s10.tif"), ("f", "s9.tif"), ("g", "z1.tif"), ("g", "B.tif"), ("h", "a1.tif"), ("h", "b1.tif")], "g string, n string")
    rows = catalog.order_slices(mixed, "g", "n").orderBy("g", "position").collect()
    assert [r["n"] for r in rows] == ["s9.tif", "s10.tif", "B.tif", "z1.tif", "a1.tif", "b1.tif"]
    assert [r["duplicate"] for r in rows][-2:] == [True, True] and not rows[2]["numeric"]
    strict = catalog.order_slices(mixed, "g", "n", "numeric").where("unnumbered_error")
    assert {r["g"] for r in strict.collect()} == {"g"}


def test_library_validation(spark, tmp_path):
    good = {"sample_identifier": "s1", "patient_id": "p", "disease": "c", "step": 0, "z_index": 1, "slice_start": 0, "slice_end": 70}
    for folder, change, csv in (("s1", {}, True), ("s2", {}, True), ("s3", {"sample_identifier": "s3", "slice_end": 0}, True),
                                ("s4", {"sample_identifier": "s4", "morphometry_csv": "../s1/morphometry.csv"}, True),
                                ("s5", {"sample_identifier": "s5"}, False)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metadata.json").write_text(json.dumps({**good, **change}))
        if csv:
            (tmp_path / folder / "morphometry.csv").write_text("a\n1\n")
    rows = {r["folder"]: r for r in library.validate_library(library.read_library(spark, str(tmp_path))).collect()}
    assert rows["s1"]["error"] is None and rows["s1"]["label"] == "c"
    assert rows["s2"]["error"] == "sample_identifier mismatch"
    assert rows["s3"]["error"] == "slice_start must be lower than slice_end"
    assert rows["s4"]["error"] == "morphometry_csv must resolve inside the folder"
    assert rows["s5"]["error"] == "morphometry_csv not found"


def nifti_bytes(array, kind, code):
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, 3, *array.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<h", header, 70, code)
    struct.pack_into("<8f", header, 76, 1, 0.0016, 0.0016, 0.002, 1, 1, 1, 1)
    struct.pack_into("<3f", header, 108, 352, 1, 0)
    header[123] = 2
    return bytes(header) + array.astype(kind).tobytes()


def test_nifti_slices(spark, tmp_path):
    array = np.arange(3 * 4 * 5).reshape(3, 4, 5)
    (tmp_path / "a.nii").write_bytes(nifti_bytes(array, "<u2", 512))
    (tmp_path / "b_Z0.0mm.nii.gz").write_bytes(gzip.compress(nifti_bytes(array + 1, "<f4", 16)))
    slices = nifti.read_slices(spark, str(tmp_path))
    assert slices.count() == 6
    got = {}
    for r in nifti.slices_to_voxels(slices).collect():
        got[r["volume_id"].endswith(".gz"), r["z"], r["y"], r["x"]] = r["v"]
    for (zipped, z, y, x), v in got.items():
        assert v == array[z, y, x] + zipped
    head = slices.head()
    assert head["unit"] == "mm" and np.allclose(head["voxel_size"], [0.0016, 0.0016, 0.002])


def test_nifti_files_of_several_volumes(spark, tmp_path):
    array = np.arange(2 * 3 * 4 * 5 * 6).reshape(2, 3, 4, 5, 6)  # axes 5, 4 (volumes), z, y, x
    head = bytearray(nifti_bytes(array[0, 0], "<i4", 8)[:352])
    struct.pack_into("<8h", head, 40, 5, *array.shape[::-1], 1, 1)
    raw = bytes(head) + array.astype("<i4").tobytes()
    (tmp_path / "a.nii").write_bytes(raw)
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(raw))
    found = nifti.read_slices(spark, str(tmp_path)).collect()
    assert len(found) == 2 * 2 * 3 * 4
    volumes = array.reshape(6, 4, 5, 6)
    assert {(r["volume_id"].rsplit("/", 1)[1], r["z"]) for r in found} == {
        (f"{name}#{t}", z) for name in ("a.nii", "b.nii.gz") for t in range(6) for z in range(4)
    }
    for r in found:
        assert list(r["pixels"]) == volumes[int(r["volume_id"].rsplit("#")[-1]), r["z"]].ravel().tolist()
