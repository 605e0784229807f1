"""Queries that score every run by the specification of its own task, next to their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrace.operators import task_scoring as scoring
from voxtrace.plans.views_sql import TRACE
from voxtrace.sources.tables import table, trace_events

# Seven tasks; task 6 has no specification at all.
ROUTING = [
    (0, "view", ["view", "click"], []),
    (1, None, ["purchase"], ["error"]),
    (2, "", [], []),
    (3, "click", [], ["signup"]),
    (4, None, [], []),
    (5, "error", ["view", "view", "signup"], ["nothing"]),
]
TOOLS = [
    (0, ["click_0", "main_graph_tool_view_1"], [], ["click_1", "purchase_0", "click_1"], False, None),
    (1, [], ["error_3"], [], False, True),
    (2, [], [], [], False, None),
    (3, ["signup_0"], [], ["view_0"], True, False),
    (4, [], [], [], True, True),
    (5, [], [], ["view_0", "view_0", "purchase_2", "click_3"], False, False),
]
ARTIFACTS = [
    (0, True, [([".html", "/"], 2), (["ref=x"], 1)]),
    (1, True, []),
    (2, False, [([".html"], 9)]),
    (3, None, [([".html"], 1)]),
    (4, True, [(["1", "2", "3"], 1)]),
    (5, True, [(["zzz"], 0), (["/"], 1)]),
]
RULES = {
    0: {"high": "k > 50", "even": "k % 2 = 0"},
    1: {"high": "k > 80"},
    2: {"ratio": "try_divide(value, k - 50) < 1"},
    3: {"even": "k % 2 = 0", "cheap": "value < 40"},
    5: {"cheap": "value < 40"},
}


def _runs(spark, sf_dir):
    """A run for each customer; most of them have no event."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("run_id"), (key % 7).cast("int").alias("task_id"), (key % 3).cast("int").alias("sandbox_attempts")
    )


def _events(spark, sf_dir):
    """Trace events, with views of large value in the sandbox."""
    sandbox = (F.col("route") == "view") & (F.col("value") > 150)
    return trace_events(spark, sf_dir).withColumn(
        "route", F.when(sandbox, scoring.SANDBOX_ROUTE).otherwise(F.col("route"))
    )


def task_routing(spark, sf_dir):
    specs = spark.createDataFrame(
        ROUTING, "task_id int, primary string, necessary array<string>, forbidden array<string>"
    )
    return scoring.score_routing(_runs(spark, sf_dir), specs, trace_events(spark, sf_dir))


def task_tools(spark, sf_dir):
    specs = spark.createDataFrame(
        TOOLS,
        "task_id int, expected array<string>, forbidden array<string>, sequence array<string>, "
        "exact_set boolean, requires_sandbox boolean",
    )
    number = F.floor(F.get_json_object("args", "$.k").cast("int") / 25).cast("string")
    calls = trace_events(spark, sf_dir).select(
        "run_id",
        "ts",
        "event_id",
        F.concat("route", F.lit("_"), number).alias("tool"),
        "success",
        ((F.col("route") != "view") | (F.col("run_id") > 100)).alias("flagged"),
    )
    return scoring.score_tools(_runs(spark, sf_dir), specs, calls, _events(spark, sf_dir))


def task_artifacts(spark, sf_dir):
    specs = spark.createDataFrame(
        ARTIFACTS, "task_id int, requires boolean, groups array<struct<extensions:array<string>,min_count:int>>"
    )
    files = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 5).cast("bigint").alias("run_id"),
        F.upper("url").alias("path"),
        F.col("url").startswith("https").alias("registered"),
    )
    return scoring.score_artifacts(_runs(spark, sf_dir), specs, files)


def task_rules(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 7).cast("int").alias("task_id"),
        "value",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
    )
    rules = spark.createDataFrame(
        [(task, rule, text) for task, own in RULES.items() for rule, text in own.items()],
        "task_id int, rule string, text string",
    )
    return scoring.rules_by_task(answers, ["event_id"], rules).drop("error")


QUERIES = {f.__name__: f for f in (task_routing, task_tools, task_artifacts, task_rules)}


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]::VARCHAR[]"
    return f"'{value}'" if isinstance(value, str) else str(value)


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


RUNS = """runs AS (SELECT c_custkey AS run_id, (c_custkey % 7)::INTEGER AS task_id,
    (c_custkey % 3)::INTEGER AS attempts FROM customer)"""
PLAIN_TOOLS = [(t, [x.removeprefix("main_graph_tool_") for x in e], *rest) for t, e, *rest in TOOLS]
GROUPS = [(t, k, e, n) for t, _, groups in ARTIFACTS for k, (e, n) in enumerate(groups)]

ORACLES = {
    "task_routing": f"""WITH {TRACE}, {RUNS},
      specs(task_id, primary_route, necessary, forbidden) AS ({_values(ROUTING)}),
      seen AS (SELECT run_id, arg_min(route, (ts, event_id)) AS first_route, list(route) AS routes,
        count(*) > count(DISTINCT route) AS repeated FROM trace GROUP BY run_id),
      w AS (SELECT run_id, task_id, nullif(primary_route, '') AS p, coalesce(necessary, []) AS n,
        coalesce(forbidden, []) AS f FROM runs LEFT JOIN specs USING (task_id)),
      j AS (SELECT run_id, task_id, first_route, p IS NULL AND len(n) = 0 AND len(f) = 0 AS skipped,
        p IS NULL OR coalesce(first_route = p, FALSE) AS a1, NOT list_has_any(coalesce(routes, []), f) AS a2,
        NOT coalesce(repeated, FALSE) AS a3, list_has_all(coalesce(routes, []), n) AS a4
        FROM w LEFT JOIN seen USING (run_id))
      SELECT run_id, task_id, first_route, skipped OR a1 AS a1_primary, skipped OR a2 AS a2_none_forbidden,
        skipped OR a3 AS a3_none_repeated, skipped OR a4 AS a4_required_present,
        CASE WHEN skipped THEN 'skipped' WHEN a1 AND a2 AND a4 THEN 'passed' ELSE 'failed' END AS status FROM j""",
    "task_tools": f"""WITH {TRACE}, {RUNS},
      specs(task_id, expected, forbidden, sequence, exact_set, requires) AS ({_values(PLAIN_TOOLS)}),
      named AS (SELECT *, route || '_' || (json_extract_string(args, '$.k')::INTEGER // 25) AS tool,
        route <> 'view' OR run_id > 100 AS flagged FROM trace),
      calls AS (SELECT * FROM named JOIN (SELECT run_id, bool_or(flagged) AS anyf FROM named GROUP BY run_id)
        USING (run_id) WHERE flagged OR NOT anyf),
      seen AS (SELECT run_id, list(tool) AS tools, list(tool) FILTER (success) AS good,
        ',' || string_agg(tool, ',' ORDER BY ts, event_id) FILTER (success) || ',' AS line FROM calls GROUP BY run_id),
      box AS (SELECT DISTINCT run_id, TRUE AS used FROM trace WHERE route = 'view' AND value > 150),
      w AS (SELECT run_id, task_id, attempts, coalesce(expected, []) AS e, coalesce(forbidden, []) AS f,
        coalesce(sequence, []) AS s, coalesce(exact_set, FALSE) AS x, requires FROM runs LEFT JOIN specs USING (task_id)),
      j AS (SELECT w.*, coalesce(tools, []) AS t, coalesce(good, []) AS g, coalesce(line, '') AS l,
        coalesce(used, FALSE) AS used, len(e) + len(f) + len(s) > 0 AS limited
        FROM w LEFT JOIN seen USING (run_id) LEFT JOIN box USING (run_id)),
      k AS (SELECT *, CASE WHEN len(e) > 0 THEN len(list_filter(t, lambda i: NOT list_contains(e, i))) ELSE 0 END AS other FROM j),
      p AS (SELECT *, list_has_all(g, e) AND NOT list_has_any(t, f) AND (NOT x OR other = 0) AS c1,
        len(s) = 0 OR regexp_matches(l, ',' || array_to_string(s, ',(?:.*,)?') || ',') AS c2,
        CASE WHEN requires THEN used AND attempts <= 1 WHEN NOT requires THEN NOT used ELSE TRUE END AS c3,
        NOT limited AND requires IS NULL AS skipped FROM k)
      SELECT run_id, task_id, other::BIGINT AS unexpected_calls, skipped OR c1 AS c1_tools, skipped OR c2 AS c2_order,
        skipped OR c3 AS c3_sandbox, CASE WHEN skipped THEN 'skipped'
          WHEN CASE WHEN limited THEN c1 AND c2 ELSE c3 END THEN 'passed' ELSE 'failed' END AS status FROM p""",
    "task_artifacts": f"""WITH {RUNS},
      specs(task_id, requires) AS ({_values([r[:2] for r in ARTIFACTS])}),
      needs(task_id, n, extensions, least) AS ({_values(GROUPS)}),
      files AS (SELECT page_id // 5 AS run_id, lower(url) AS path, starts_with(url, 'https') AS registered FROM pages),
      t AS (SELECT run_id, count(*) AS files, count(*) FILTER (registered) AS reg FROM files GROUP BY run_id),
      g AS (SELECT run_id, n, least, count(path) FILTER (hit) AS c, count(path) FILTER (hit AND registered) AS r FROM (
          SELECT runs.run_id, n, least, path, registered,
            len(list_filter(extensions, lambda e: ends_with(path, lower(e)))) > 0 AS hit
          FROM runs JOIN needs USING (task_id) LEFT JOIN files ON files.run_id = runs.run_id) GROUP BY ALL),
      e AS (SELECT run_id, bool_and(c >= least) AS types, bool_and(r >= least) AS rtypes FROM g GROUP BY run_id),
      j AS (SELECT run_id, task_id, requires, requires IS NULL OR NOT requires AS free, coalesce(files, 0) > 0 AS d1,
        coalesce(files, 0) > 0 AND coalesce(types, TRUE) AS d2,
        coalesce(files, 0) > 0 AND coalesce(reg, 0) > 0 AND coalesce(rtypes, TRUE) AS d3
        FROM runs LEFT JOIN specs USING (task_id) LEFT JOIN t USING (run_id) LEFT JOIN e USING (run_id))
      SELECT run_id, task_id, free OR d1 AS d1_created, free OR d2 AS d2_types, free OR d3 AS d3_registered,
        CASE WHEN requires IS NULL THEN 'skipped' WHEN free OR (d1 AND d2 AND d3) THEN 'passed' ELSE 'failed' END AS status
      FROM j""",
    "task_rules": """WITH a AS (SELECT event_id, (user_id % 7)::INTEGER AS task_id, value,
        json_extract_string(props, '$.k')::BIGINT AS k FROM events)
      SELECT * FROM (
        SELECT event_id, task_id, 'high' AS rule, coalesce(k > CASE task_id WHEN 0 THEN 50 ELSE 80 END, FALSE) AS passed
          FROM a WHERE task_id IN (0, 1)
        UNION ALL SELECT event_id, task_id, 'even', coalesce(k % 2 = 0, FALSE) FROM a WHERE task_id IN (0, 3)
        UNION ALL SELECT event_id, task_id, 'ratio', coalesce(value / nullif(k - 50, 0) < 1, FALSE) FROM a WHERE task_id = 2
        UNION ALL SELECT event_id, task_id, 'cheap', coalesce(value < 40, FALSE) FROM a WHERE task_id IN (3, 5))""",
}
