"""Queries over tasks, run traces, messages and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrace.functions import payload, predicates, text
from voxtrace.operators import artifacts as art
from voxtrace.operators import run_lines
from voxtrace.operators import tasks as task_ops
from voxtrace.operators import traces
from voxtrace.plans.views_sql import TRACE
from voxtrace.session import staging_path
from voxtrace.sources.tables import messages, table, trace_events
from voxtrace.streaming import rollup


def trace_index(spark, sf_dir):
    rows = traces.run_index(trace_events(spark, sf_dir))
    return rows.withColumn("started_at", F.col("started_at").cast("string")).withColumn(
        "ended_at", F.col("ended_at").cast("string")
    )


def trace_routes(spark, sf_dir):
    return traces.ordered_routes(trace_events(spark, sf_dir))


def trace_stream(spark, sf_dir):
    """The run index kept by a streaming query over appended JSON lines."""
    root = staging_path(spark, "stream")
    trace_events(spark, sf_dir).drop("value").write.json(f"{root}/events")
    query = rollup.keep_index(
        rollup.read_event_stream(spark, f"{root}/events"), f"{root}/index", f"{root}/progress"
    )
    query.awaitTermination()
    rows = rollup.latest_index(spark, f"{root}/index")
    return rows.drop("started_at", "ended_at", "first_route", "last_route")


def trace_lines(spark, sf_dir):
    """One JSON line per run, written and read back; customers stand for the sessions of runs."""
    key = F.col("c_custkey")
    sessions = table(spark, sf_dir, "customer").select(
        key.alias("run_id"),
        F.when(key % 5 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" #/"), key % 3)).alias("test_name"),
        F.when(key % 7 != 0, F.col("c_name")).alias("session_id"),
        F.when(key % 7 != 0, F.concat(F.lit("/sessions/"), "c_name")).alias("session_path"),
    )
    folder = staging_path(spark, "run_lines")
    run_lines.write_lines(run_lines.line_parts(trace_events(spark, sf_dir), sessions, "traces"), folder)
    rows = run_lines.read_lines(spark, folder)
    return rows.withColumn("routes", F.array_join("routes", ","))


def task_validate(spark, sf_dir):
    """Tasks as JSON text with every kind of fault."""
    kind, size = F.col("p_type"), F.col("p_size")
    empty = F.lit("{}")
    keys = [F.lit(f'"{k}":') for k in task_ops.EVALUATION_KEYS]
    fifth = F.when((kind == "MEDIUM") & (size > 25), F.lit("7")).otherwise(empty)
    fourth = F.when(kind == "LARGE", F.lit("")).otherwise(F.concat(keys[3], empty, F.lit(",")))
    extra = F.when(kind == "ECONOMY", F.lit(',"extra":{}')).otherwise(F.lit(""))
    evaluation = F.concat(
        F.lit("{"), keys[0], empty, F.lit(","), keys[1], empty, F.lit(","), keys[2], empty,
        F.lit(","), fourth, keys[4], fifth, extra, F.lit("}"),
    )
    name = F.concat(F.lit('"'), "p_name", F.lit(" "), "p_brand", F.lit('"'))
    identity = F.when(kind == "SMALL", F.lit("12")).otherwise(name)
    document = F.concat(F.lit('{"id":'), identity, F.lit(',"evaluation":'), evaluation, F.lit("}"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(kind == "PROMO", F.lit("[1]")).otherwise(document).alias("doc")
    )
    return task_ops.validate_tasks(parts, "p_partkey", "doc")


def expand_variants(spark, sf_dir):
    names = F.array_sort(F.collect_list("n_name"))
    tasks = (
        table(spark, sf_dir, "region")
        .join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
        .groupBy(F.col("r_name").alias("task_id"))
        .agg(names.alias("names"))
        .select(
            "task_id",
            F.col("task_id").alias("source_task_id"),
            F.concat("names", F.array(F.concat(F.lit(" "), F.get("names", F.lit(0)), F.lit(" ")))).alias("patient_id"),
            F.array(F.lit("data/cohort/group_1"), F.lit("data/cohort/ "), F.lit("data/other ")).alias("dataset"),
            F.array(F.lit("s1"), F.lit("s2"), F.lit(" s3")).alias("sample_id"),
        )
    )
    by_patient = task_ops.expand_field(tasks, "patient_id", text.slug)
    both = task_ops.expand_field(by_patient, "dataset", text.dataset_slug, "sample_id")
    first = [F.get(c, F.lit(0)).alias(c) for c in ("patient_id", "dataset", "sample_id")]
    return both.select("task_id", "source_task_id", *first)


def _part_paths(spark, sf_dir):
    kind = F.col("p_type")
    suffix = (
        F.when(kind == "SMALL", "_original.nii.gz").when(kind == "LARGE", ".v2.tif ")
        .when(kind == "PROMO", "#1/").otherwise("")
    )
    path = F.concat(F.lit("data/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), suffix)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", path.alias("path"))


def slug(spark, sf_dir):
    return _part_paths(spark, sf_dir).select(
        "p_partkey",
        text.slug(F.col("p_brand")).alias("brand_slug"),
        text.path_slug(F.col("path")).alias("path_slug"),
        text.dataset_slug(F.col("path")).alias("dataset_slug"),
    )


def render(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_name",
        "p_size",
        F.concat(F.lit("{p_name} of {p_size}"), F.when(F.col("p_size") > 25, " {nothing}").otherwise("")).alias("p_type"),
        F.lit("Audit {p_type}: {p_brand} {{p_size}}").alias("question"),
        F.col("p_brand"),
    )
    return parts.select(
        "p_partkey",
        text.render(F.col("question"), ["p_name", "p_size", "p_type", "p_brand"]).alias("rendered"),
    )


def route_checks(spark, sf_dir):
    return traces.route_checks(
        trace_events(spark, sf_dir), "view", ["view", "click"], ["signup"]
    )


def dup_tasks(spark, sf_dir):
    requests = trace_events(spark, sf_dir).select(
        "run_id", "ts", "event_id", "route", F.col("args").alias("task")
    )
    return traces.repeated_tasks(requests).select("run_id", "event_id", "route", "occurrence")


def judge_norm(spark, sf_dir):
    normal, status = traces.judge_verdict(F.pmod("p_size", F.lit(7)))
    return table(spark, sf_dir, "part").select(
        "p_partkey", normal.alias("normalized"), status.alias("status")
    )


def _calls(spark, sf_dir):
    number = F.floor(F.get_json_object("args", "$.k").cast("int") / 25).cast("string")
    name = F.concat("route", F.lit("_"), number)
    tool = (
        F.when(F.col("route") == "signup", "create_session")
        .when(F.col("route") == "click", F.concat(F.lit(traces.TOOL_PREFIX), name))
        .otherwise(F.concat(F.lit(" "), name))
    )
    return trace_events(spark, sf_dir).select(
        "run_id", "ts", "event_id", tool.alias("tool"), "success",
        ((F.col("route") != "view") | (F.col("run_id") > 100)).alias("flagged"),
    )


def tool_checks(spark, sf_dir):
    return traces.tool_checks(
        _calls(spark, sf_dir),
        expected=["click_0", "purchase_2"],
        forbidden=["error_3"],
        sequence=["click_1", "purchase_0", "click_1"],
        sandbox="purchase_1",
        requires_sandbox=True,
    )


def subsequence(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    return traces.in_order(
        events, trace_events(spark, sf_dir), "route", ["view", "click", "view", "purchase", "signup"]
    )


def artifact_checks(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 5).cast("bigint").alias("run_id"),
        F.upper("url").alias("path"),
        F.col("url").startswith("https").alias("registered"),
    )
    return traces.artifact_checks(files, [([".html", "/"], 2), (["ref=x"], 1)])


def _answers(spark, sf_dir):
    kind, props = F.col("event_type"), F.col("props")
    answer = (
        F.when(kind == "view", F.concat(F.lit("Answer: {broken "), props, F.lit(" done")))
        .when(kind == "signup", F.concat(F.regexp_replace(props, '"', "'"), F.lit(" ")))
        .when(kind == "error", F.lit("no answer [here"))
        .when(kind == "purchase", F.concat(F.lit("values [1, 2] "), F.when(F.col("value") > 20, props).otherwise("")))
        .otherwise(props)
    )
    parsed = table(spark, sf_dir, "events").select(
        "event_id", "value", task_ops.parse_answer(answer).alias("a")
    )
    return parsed.select(
        "event_id",
        "value",
        F.col("a.kind").alias("kind"),
        F.get_json_object("a.json", "$.k").try_cast("bigint").alias("k"),
    )


def answer_parse(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", "kind", "k")


RULES = {
    "high": "k > 50",
    "even": "k % 2 = 0",
    "ratio": "try_divide(value, k - 50) < 1",
    "unknown_field": "missing_field > 1",
    "not_sql": "k >",
}


def rules(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")
    )
    return task_ops.evaluate_rules(answers, ["event_id"], RULES)


def answer_points(spark, sf_dir):
    checked = task_ops.evaluate_rules(
        _answers(spark, sf_dir), ["event_id"], {"low": "k < 50", "cheap": "value < 40"}
    )
    return task_ops.final_answer_points(checked, ["event_id"])


def predicate_checks(spark, sf_dir):
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    span = F.concat_ws("-", F.lit("slices 3"), F.col("l_linenumber"))
    as_text = F.when(F.col("l_returnflag") == "R", " NULL ").when(
        F.col("l_returnflag") == "A", F.concat(quantity.cast("string"), F.lit("x"))
    ).otherwise(quantity.cast("string"))
    checks = {
        "positive": predicates.positive_finite(discount),
        "in_range": predicates.number_or_none_in_range(as_text, 5, 20),
        "close": predicates.numbers_close(discount, F.col("l_tax"), 0.5, 0.01),
        "span": predicates.slice_range_matches(
            span, F.col("l_linenumber"), F.col("l_linenumber") + 1, 3, 4
        ),
    }
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
        .agg(F.count("*").alias("rows"))
    )


def variant_predicates(spark, sf_dir):
    """Type predicates over parsed values of every kind."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    shown = (
        F.when(kind == "view", k)
        .when(kind == "click", F.concat(k, F.lit(".5")))
        .when(kind == "signup", F.concat(F.lit("["), k, F.lit(",-1.5]")))
        .when(kind == "error", F.when(F.col("value") > 20, "true").otherwise('"text"'))
        .otherwise(F.concat(F.lit("["), k, F.lit("]")))
    )
    value = F.try_parse_json(shown)
    return table(spark, sf_dir, "events").select(
        "event_id",
        predicates.is_int(value).alias("int"),
        predicates.is_positive_int(value).alias("positive_int"),
        predicates.is_bool(value).alias("bool"),
        predicates.is_string(value).alias("string"),
        predicates.is_finite_number(value).alias("finite"),
        predicates.is_int_list(value).alias("int_list"),
        predicates.is_finite_number_list(value).alias("number_list"),
    )


def _allowed(spark, sf_dir):
    """Wanted ids: nations of one region, shifted so that some match nothing."""
    return (
        table(spark, sf_dir, "nation")
        .where("n_regionkey = 1")
        .select((F.col("n_nationkey").cast("bigint") * 70).alias("wanted"))
    )


def task_filter(spark, sf_dir):
    tasks = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("task_id"), F.col("c_nationkey").cast("bigint").alias("source_id")
    )
    kept, unknown = task_ops.filter_tasks(tasks, _allowed(spark, sf_dir), "task_id", "source_id")
    return kept.select("task_id", "source_id").unionByName(
        unknown.select(F.lit(None).cast("bigint").alias("task_id"), F.col("wanted").alias("source_id"))
    )


def tool_calls(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.pmod(F.length("text"), F.lit(20)).cast("string").alias("call_id"),
        F.lower(F.substring("text", 1, 2)).alias("name"),
        F.when(F.col("role") == "assistant", "ai").otherwise("tool").alias("kind"),
        F.when(F.col("role") == "system", 1).otherwise(0).cast("bigint").alias("source"),
        F.col("turn").alias("position"),
    )
    done = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.get_json_object("props", "$.k").alias("call_id"),
        F.col("event_type").alias("name"),
        F.lit("execution_trace").alias("kind"),
        F.lit(2).cast("bigint").alias("source"),
        F.col("event_id").alias("position"),
    )
    return traces.unique_calls(said.unionByName(done))


def _found_artifacts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract(url, r"^[a-z]+://[^/]*/([a-z]+/\d?)", 1).alias("path"),
        F.when(url.startswith("https"), 1).otherwise(0).cast("bigint").alias("source"),
        F.col("page_id").alias("position"),
    )


def artifacts_last(spark, sf_dir):
    return traces.unique_artifacts(_found_artifacts(spark, sf_dir), "last")


def artifacts_first(spark, sf_dir):
    return traces.unique_artifacts(_found_artifacts(spark, sf_dir), "first")


def msg_split(spark, sf_dir):
    said = messages(spark, sf_dir)
    visible = said.where("type <> 'system'")
    internal = said.where("type = 'system' OR turn = 0")
    return traces.split_messages(visible, internal).select("run_id", "turn", "type", "visibility")


def _routes_and_tools(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    routes = events.where(F.col("route").isin("view", "signup")).withColumn("key", F.col("route"))
    high = F.get_json_object("args", "$.k").cast("int") > 30
    tools = events.where(~F.col("route").isin("view", "signup")).withColumn(
        "key", F.when(high, "view").otherwise("signup")
    )
    return tuple(
        d.select("run_id", "ts", "event_id", "key", "success", F.col("route").alias("tool"))
        for d in (routes, tools)
    )


def interval_assign(spark, sf_dir):
    return traces.assign_to_routes(*_routes_and_tools(spark, sf_dir)).drop("success")


def subruns(spark, sf_dir):
    return traces.sub_runs(*_routes_and_tools(spark, sf_dir))


def run_status(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    return traces.run_status(
        events, events.where(F.col("value") > 185).select("run_id")
    )


def last_assistant(spark, sf_dir):
    return traces.last_assistant_message(messages(spark, sf_dir))


def token_est(spark, sf_dir):
    return traces.token_estimate(messages(spark, sf_dir), 400).drop("chars")


def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.truncate(F.col("text")).alias("text")
    )


def reduce_lists(spark, sf_dir):
    kept = text.reduce_list(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(kept["items"]).cast("bigint").alias("items"),
        F.round(F.get(kept["items"], F.lit(text.MAX_LIST - 1)).cast("double"), 6).alias("last_item"),
        kept["omitted"].alias("omitted"),
    )


def reduced_payloads(spark, sf_dir):
    """Nested payloads of the documents, reduced: what is left of their texts, lists, maps and trees."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    numbers = F.sequence(F.lit(1), F.pmod(key, F.lit(100)).cast("int") + 1)
    leaf = F.struct(F.lit("file").alias("type"))
    tree = F.struct(
        F.lit("root").alias("name"), F.col("source").alias("path"), F.lit("directory").alias("type"),
        F.array_repeat(leaf, F.pmod(key, F.lit(40)).cast("int")).alias("children"),
    )
    inner = F.struct(
        F.array(F.struct("text")).alias("parts"),
        F.map_from_arrays(F.transform(numbers, lambda n: F.concat(F.lit("k"), n)), numbers).alias("values"),
        tree.alias(payload.TREE_KEY),
    )
    whole = F.to_json(F.struct("doc_id", F.split("text", " ").alias("words"), inner.alias("inner")))
    small = docs.select("doc_id", payload.reduce_payload(whole).alias("_small"))

    def part(path: str):
        return F.get_json_object("_small", path)

    words = F.from_json(part("$.words"), "array<string>")
    return small.select(
        "doc_id",
        part("$.inner.parts[0].text").alias("text"),
        F.array_join(words, " ").alias("words"),
        F.size(F.json_object_keys(part("$.inner.values"))).cast("bigint").alias("n_keys"),
        part("$.inner.values.omitted_keys").cast("bigint").alias("omitted_keys"),
        part("$.inner.tree_struct.root_path").alias("root_path"),
        part("$.inner.tree_struct.file_count").cast("bigint").alias("files"),
        part("$.inner.tree_struct.directory_count").cast("bigint").alias("folders"),
    )


def reduced_messages(spark, sf_dir):
    return payload.reduce_messages(messages(spark, sf_dir))


def registry_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    row = [
        F.when(priority == "1-URGENT", F.col("o_custkey").cast("string")).alias("id"),
        F.when(priority == "2-HIGH", F.concat(F.lit("in/"), F.col("o_custkey"))).otherwise("").alias("origin_path"),
        F.when(priority != "5-LOW", F.concat(F.lit("out/"), F.col("o_custkey"))).alias("path"),
        F.col("o_orderkey").alias("position"),
    ]
    left = orders.select(*row, F.col("o_totalprice").alias("value"))
    right = orders.where("o_orderstatus = 'F'").select(*row, (-F.col("o_totalprice")).alias("value"))
    return art.merge_registries(left, right).withColumn("side", F.col("side").cast("bigint"))


def lineage(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    parent = F.when(size > 3, F.floor(key / 2)).cast("bigint")
    artifacts = table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.concat(F.lit("p"), key).alias("path"),
        F.coalesce(F.concat(F.lit("p"), parent), F.lit("upload")).alias("input_path"),
    )
    return art.lineage(art.link_parents(artifacts))


QUERIES = {
    f.__name__: f
    for f in (
        trace_index, trace_lines, trace_routes, trace_stream, task_validate, expand_variants, slug, render,
        route_checks, dup_tasks, judge_norm, tool_checks, subsequence, artifact_checks,
        answer_parse, rules, answer_points, predicate_checks, variant_predicates, task_filter,
        tool_calls, artifacts_last, artifacts_first, msg_split, interval_assign, subruns,
        run_status, last_assistant, token_est, truncate, reduce_lists, registry_merge, lineage,
        reduced_payloads, reduced_messages,
    )
}

EVALUATION_ERROR = f"""CASE WHEN p_type = 'PROMO' THEN 'must be a JSON object'
  WHEN p_type = 'SMALL' THEN 'must contain a non-empty string id'
  WHEN first_key < p_partkey THEN 'duplicate task id'
  WHEN p_type = 'LARGE' THEN 'missing: {task_ops.EVALUATION_KEYS[3]}'
  WHEN p_type = 'ECONOMY' THEN 'unknown: extra'
  WHEN p_type = 'MEDIUM' AND p_size > 25 THEN 'not an object: {task_ops.EVALUATION_KEYS[4]}' END"""

CALLS = f"""{TRACE}, raw_calls AS (SELECT run_id, ts, event_id, success, route <> 'view' OR run_id > 100 AS flagged,
    CASE route WHEN 'signup' THEN 'create_session' ELSE route || '_' || (json_extract_string(args, '$.k')::INTEGER // 25) END
      AS tool FROM trace),
  calls AS (SELECT * FROM raw_calls JOIN (SELECT run_id, bool_or(flagged) AS any_flag FROM raw_calls GROUP BY run_id)
    USING (run_id) WHERE flagged OR NOT any_flag)"""


def _letters(source: str, item: str, codes: dict[str, str], where: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items())
    return f"""SELECT run_id, string_agg(CASE {item} {cases} ELSE '.' END, '' ORDER BY ts, event_id)
      AS line FROM {source} WHERE {where} GROUP BY run_id"""


ANSWERS = """a AS (SELECT event_id, value, json_extract_string(props, '$.k')::BIGINT AS n, event_type FROM events),
  answers AS (SELECT event_id, value,
    CASE event_type WHEN 'error' THEN 'text' WHEN 'purchase' THEN CASE WHEN value > 20 THEN 'dict' ELSE 'list' END
      ELSE 'dict' END AS kind,
    CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND NOT value > 20) THEN NULL ELSE n END AS k FROM a)"""

FOUND = """found AS (SELECT regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+/[0-9]?)', 1) AS path,
    (CASE WHEN url LIKE 'https%' THEN 1 ELSE 0 END)::BIGINT AS source, page_id AS position FROM pages)"""


def _cut_sql(value: str, limit: int) -> str:
    return (
        f"CASE WHEN length({value}) > {limit} THEN substr({value}, 1, {limit}) || '... [truncated ' "
        f"|| (length({value}) - {limit}) || ' chars]' ELSE {value} END"
    )


def _found_sql(pick: str) -> str:
    return f"""WITH {FOUND} SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name,
      {pick}(source, source * 1000000000 + position) AS source,
      {pick}(position, source * 1000000000 + position) AS position, count(*) AS seen FROM found GROUP BY path"""


ROUTED = f"""{TRACE}, routes AS (SELECT run_id, ts, event_id, route AS key FROM trace WHERE route IN ('view', 'signup')),
  tools AS (SELECT run_id, ts, event_id, success, route AS tool,
      CASE WHEN json_extract_string(args, '$.k')::INTEGER > 30 THEN 'view' ELSE 'signup' END AS key
    FROM trace WHERE route NOT IN ('view', 'signup')),
  spans AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS until FROM routes),
  assigned AS (SELECT t.*, s.event_id AS route_event_id FROM tools t LEFT JOIN spans s
    ON s.run_id = t.run_id AND s.key = t.key AND t.ts >= s.ts AND (s.until IS NULL OR t.ts < s.until))"""

ORACLES = {
    "trace_index": f"""WITH {TRACE} SELECT run_id, min(ts)::VARCHAR AS started_at, max(ts)::VARCHAR AS ended_at,
      count(*) AS tool_call_count, count(*) FILTER (success) AS successful_tool_calls,
      count(*) FILTER (NOT success) AS failed_tool_calls, arg_min(route, ts) AS first_route,
      arg_max(route, ts) AS last_route FROM trace GROUP BY run_id""",
    "trace_routes": f"""WITH {TRACE}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS rn
        FROM trace)
      SELECT run_id, (rn - 1) // {traces.SEGMENT} AS segment, count(*) AS routes,
        string_agg(route, ',' ORDER BY rn) AS route_list FROM n GROUP BY ALL""",
    "trace_stream": f"""WITH {TRACE} SELECT run_id, count(*) AS tool_call_count,
      count(*) FILTER (success) AS successful_tool_calls, count(*) FILTER (NOT success) AS failed_tool_calls
      FROM trace GROUP BY run_id""",
    "trace_lines": f"""WITH {TRACE}, s AS (SELECT c_custkey AS run_id,
        CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || '_' || c_custkey % 3 ELSE '_ungrouped' END AS test_name,
        CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS session_id FROM customer),
      e AS (SELECT run_id, min(ts) AS a, max(ts) AS b, count(*) AS n, count(*) FILTER (success) AS ok,
        count(*) FILTER (NOT success) AS failed, string_agg(route, ',' ORDER BY ts, event_id) AS routes
        FROM trace GROUP BY run_id)
      SELECT run_id, coalesce(test_name, '_ungrouped') AS test_name, session_id,
        '/sessions/' || session_id AS session_path,
        strftime(a, '%Y-%m-%dT%H:%M:%S.%f') AS started_at, epoch_us(a) / 1e6 AS started_at_unix,
        strftime(b, '%Y-%m-%dT%H:%M:%S.%f') AS ended_at, epoch_us(b) / 1e6 AS ended_at_unix,
        coalesce(n, 0) AS tool_call_count, coalesce(ok, 0) AS successful_tool_calls,
        coalesce(failed, 0) AS failed_tool_calls, coalesce(routes, '') AS routes,
        'traces/' || coalesce(test_name, '_ungrouped') || '/' || coalesce(session_id, 'no_session') || '/'
          || run_id || '.json' AS run_file
      FROM s FULL JOIN e USING (run_id)""",
    "task_validate": f"""WITH p AS (SELECT *, CASE WHEN p_type NOT IN ('PROMO', 'SMALL')
        THEN p_name || ' ' || p_brand END AS task_id FROM part),
      f AS (SELECT *, min(p_partkey) OVER (PARTITION BY task_id) AS first_key FROM p)
      SELECT p_partkey, task_id, {EVALUATION_ERROR} AS error FROM f""",
    "expand_variants": """SELECT r_name || '_' || n_name || '_' || d.slug AS task_id, r_name AS source_task_id,
        n_name AS patient_id, d.path AS dataset, d.sample AS sample_id
      FROM region JOIN nation ON r_regionkey = n_regionkey,
        (SELECT unnest(['data/cohort/group_1', 'data/cohort/', 'data/other']) AS path,
          unnest(['cohort_group_1', 'cohort', 'other']) AS slug, unnest(['s1', 's2', 's3']) AS sample) d""",
    "slug": """WITH p AS (SELECT p_partkey, p_type, regexp_replace(p_brand, '[^A-Za-z0-9_.-]+', '_', 'g') AS b,
        regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS n FROM part)
      SELECT p_partkey, b AS brand_slug, CASE p_type WHEN 'LARGE' THEN n || '.v2' WHEN 'PROMO' THEN n || '_1'
          ELSE n END AS path_slug,
        CASE p_type WHEN 'SMALL' THEN n || '_original.nii.gz' WHEN 'LARGE' THEN n || '.v2.tif'
          WHEN 'PROMO' THEN n || '_1' ELSE n END AS dataset_slug FROM p""",
    "render": """SELECT p_partkey, 'Audit ' || p_name || ' of ' || p_size || CASE WHEN p_size > 25 THEN ' {nothing}'
        ELSE '' END || ': ' || p_brand || ' {' || p_size || '}' AS rendered FROM part""",
    "route_checks": f"""WITH {TRACE}, e AS (SELECT * FROM trace),
      r AS (SELECT run_id, route, count(*) AS n FROM e GROUP BY ALL),
      c AS (SELECT run_id, list(route) AS routes, coalesce(string_agg(route, ',' ORDER BY route) FILTER (n > 1), '') AS dup,
        max(n) AS most FROM r GROUP BY run_id),
      f AS (SELECT run_id, arg_min(route, ts) AS first_route FROM e GROUP BY run_id),
      j AS (SELECT run_id, first_route, first_route = 'view' AS a1_primary,
        NOT list_contains(routes, 'signup') AS a2_none_forbidden, most <= 1 AS a3_none_repeated,
        list_has_all(routes, ['view', 'click']) AS a4_required_present, dup AS repeated_routes FROM c JOIN f USING (run_id))
      SELECT *, CASE WHEN a1_primary AND a2_none_forbidden AND a4_required_present THEN 'passed' ELSE 'failed' END AS status
      FROM j""",
    "dup_tasks": f"""WITH {TRACE} SELECT run_id, event_id, route, row_number() OVER
        (PARTITION BY run_id, route, args ORDER BY ts, event_id) AS occurrence FROM trace QUALIFY occurrence > 1""",
    "judge_norm": """WITH s AS (SELECT p_partkey, p_size % 7 AS s FROM part)
      SELECT p_partkey, CASE WHEN s BETWEEN 1 AND 5 THEN round_even((s - 1) / 4, 4) END AS normalized,
        CASE WHEN s NOT BETWEEN 1 AND 5 THEN 'not_evaluated' WHEN s >= 3 THEN 'passed' ELSE 'failed' END AS status FROM s""",
    "tool_checks": f"""WITH {CALLS}, used AS (SELECT * FROM calls WHERE tool <> 'create_session'),
      m AS (SELECT run_id,
          count(DISTINCT tool) FILTER (success AND tool IN ('click_0', 'purchase_2')) AS expected_found,
          count(*) FILTER (tool = 'error_3') AS forbidden_calls,
          count(*) FILTER (tool NOT IN ('click_0', 'purchase_2')) AS unexpected_calls,
          count(*) FILTER (tool = 'purchase_1') AS sandbox FROM used GROUP BY run_id),
      o AS ({_letters("used", "tool", {"click_1": "c", "purchase_0": "p"}, "success")}),
      j AS (SELECT run_id, coalesce(expected_found, 0) AS expected_found, coalesce(forbidden_calls, 0) AS forbidden_calls,
          coalesce(unexpected_calls, 0) AS unexpected_calls,
          coalesce(expected_found, 0) = 2 AND coalesce(forbidden_calls, 0) = 0 AS c1_tools,
          coalesce(regexp_matches(line, 'c.*p.*c'), false) AS c2_order, coalesce(sandbox, 0) = 1 AS c3_sandbox
        FROM (SELECT DISTINCT run_id FROM raw_calls) LEFT JOIN m USING (run_id) LEFT JOIN o USING (run_id))
      SELECT *, CASE WHEN c1_tools AND c2_order THEN 'passed' ELSE 'failed' END AS status FROM j""",
    "subsequence": f"""WITH {TRACE}, o AS ({_letters("trace", "route",
        {"view": "v", "click": "c", "purchase": "p", "signup": "s"}, "true")})
      SELECT DISTINCT run_id, coalesce(regexp_matches(line, 'v.*c.*v.*p.*s'), false) AS found
      FROM trace LEFT JOIN o USING (run_id)""",
    "artifact_checks": """WITH f AS (SELECT page_id // 5 AS run_id, url, url LIKE 'https%' AS reg,
        url LIKE '%.html' OR url LIKE '%/' AS a, url LIKE '%ref=x' AS b FROM pages),
      c AS (SELECT run_id, count(*) AS files, count(*) FILTER (reg) AS registered_files, count(*) FILTER (a) AS group_0,
        count(*) FILTER (a AND reg) AS registered_0, count(*) FILTER (b) AS group_1,
        count(*) FILTER (b AND reg) AS registered_1 FROM f GROUP BY run_id),
      d AS (SELECT *, files > 0 AS d1_created, group_0 >= 2 AND group_1 >= 1 AS d2_types,
        registered_files > 0 AND registered_0 >= 2 AND registered_1 >= 1 AS d3_registered FROM c)
      SELECT *, CASE WHEN d1_created AND d2_types AND d3_registered THEN 'passed' ELSE 'failed' END AS status FROM d""",
    "answer_parse": f"WITH {ANSWERS} SELECT event_id, kind, k FROM answers",
    "rules": """WITH e AS (SELECT event_id, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
      SELECT event_id, unnest(['high', 'even', 'ratio', 'unknown_field', 'not_sql']) AS rule,
        unnest([k > 50, k % 2 = 0, coalesce(value / nullif(k - 50, 0) < 1, false), false, false]) AS passed FROM e""",
    "answer_points": f"""WITH {ANSWERS}, c AS (SELECT event_id, coalesce(k < 50, false) AS a, value < 40 AS b FROM answers)
      SELECT event_id, 2::BIGINT AS rules, ((NOT a)::INTEGER + (NOT b)::INTEGER)::BIGINT AS failed, a AND b AS correct
      FROM c""",
    "predicate_checks": """WITH c AS (SELECT l_discount > 0 AS positive,
        l_returnflag = 'R' OR (l_returnflag = 'N' AND l_quantity BETWEEN 5 AND 20) AS in_range,
        abs(l_discount - l_tax) <= greatest(0.5::DOUBLE * greatest(abs(l_discount), abs(l_tax)), 0.01::DOUBLE) AS close,
        l_linenumber IN (3, 4) AS span FROM lineitem)
      SELECT *, count(*) AS rows FROM c GROUP BY ALL""",
    "variant_predicates": """WITH e AS (SELECT event_id, event_type AS t, value,
        json_extract_string(props, '$.k')::BIGINT AS k FROM events)
      SELECT event_id, t = 'view' AS "int", t = 'view' AND k > 0 AS positive_int, t = 'error' AND value > 20 AS bool,
        t = 'error' AND NOT value > 20 AS "string", t IN ('view', 'click') AS finite, t = 'purchase' AS int_list,
        t IN ('purchase', 'signup') AS number_list FROM e""",
    "task_filter": """WITH w AS (SELECT n_nationkey::BIGINT * 70 AS wanted FROM nation WHERE n_regionkey = 1)
      SELECT c_custkey AS task_id, c_nationkey::BIGINT AS source_id FROM customer
        WHERE c_custkey IN (SELECT wanted FROM w) OR c_nationkey IN (SELECT wanted FROM w)
      UNION ALL SELECT NULL, wanted FROM w WHERE wanted NOT IN (SELECT c_custkey FROM customer)
        AND wanted NOT IN (SELECT c_nationkey FROM customer)""",
    "tool_calls": """WITH c AS (SELECT conv_id AS run_id, (length(text) % 20)::VARCHAR AS call_id, lower(substr(text, 1, 2)) AS name,
          CASE role WHEN 'assistant' THEN 'ai' ELSE 'tool' END AS kind,
          (CASE role WHEN 'system' THEN 1 ELSE 0 END)::BIGINT AS source, turn AS position FROM conversations
        UNION ALL SELECT user_id, json_extract_string(props, '$.k'), event_type, 'execution_trace', 2, event_id FROM events)
      SELECT *, count(*) OVER g AS seen FROM c
      WINDOW g AS (PARTITION BY run_id, call_id, name, kind)
      QUALIFY row_number() OVER (PARTITION BY run_id, call_id, name, kind ORDER BY source, position) = 1""",
    "artifacts_last": _found_sql("arg_max"),
    "artifacts_first": _found_sql("arg_min"),
    "msg_split": """WITH v AS (SELECT * FROM conversations WHERE role <> 'system'),
      i AS (SELECT * FROM conversations WHERE role = 'system' OR turn = 0)
      SELECT conv_id AS run_id, turn, role AS type, 'visible' AS visibility FROM v
      UNION ALL SELECT conv_id, turn, role, 'internal' FROM i ANTI JOIN v USING (conv_id, role, text)""",
    "interval_assign": f"WITH {ROUTED} SELECT run_id, event_id, key, tool, route_event_id FROM assigned",
    "subruns": f"""WITH {ROUTED},
      own AS (SELECT route_event_id AS event_id, count(*) AS n, count(*) FILTER (NOT success) AS f,
        string_agg(DISTINCT tool, ',' ORDER BY tool) AS t FROM assigned WHERE route_event_id IS NOT NULL GROUP BY ALL),
      keyed AS (SELECT run_id, key, count(*) AS kn, count(*) FILTER (NOT success) AS kf,
        string_agg(DISTINCT tool, ',' ORDER BY tool) AS kt FROM tools GROUP BY ALL)
      SELECT run_id, key, event_id, row_number() OVER (PARTITION BY run_id, key ORDER BY ts, event_id) AS call_index,
        CASE WHEN n IS NULL THEN 'key' ELSE 'interval' END AS assigned_by, coalesce(n, kn, 0) AS tool_events,
        coalesce(t, kt, '') AS tool_names, CASE WHEN coalesce(f, kf, 0) > 0 THEN 'failed' ELSE 'completed' END AS status
      FROM routes LEFT JOIN own USING (event_id) LEFT JOIN keyed USING (run_id, key)""",
    "run_status": f"""WITH {TRACE} SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM trace WHERE value > 185) THEN 'error'
        WHEN count(*) FILTER (NOT success) > 0 THEN 'completed_with_tool_errors' ELSE 'completed' END AS status
      FROM trace GROUP BY run_id""",
    "last_assistant": """SELECT conv_id AS run_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations
      WHERE role = 'assistant' GROUP BY conv_id""",
    "token_est": """SELECT conv_id AS run_id, ceil(sum(length(text)) / 4)::BIGINT AS tokens,
      ceil(sum(length(text)) / 4) > 400 AS reduce FROM conversations GROUP BY conv_id""",
    "truncate": f"""SELECT doc_id, CASE WHEN length(text) > {text.MAX_TEXT} THEN substr(text, 1, {text.MAX_TEXT})
      || '... [truncated ' || (length(text) - {text.MAX_TEXT}) || ' chars]' ELSE text END AS text FROM documents""",
    "reduce_lists": f"""SELECT vec_id, least(len(embedding), {text.MAX_LIST}) AS items,
      round(embedding[{text.MAX_LIST}]::DOUBLE, 6) AS last_item, greatest(len(embedding) - {text.MAX_LIST}, 0) AS omitted
      FROM embeddings""",
    "reduced_payloads": f"""WITH w AS (SELECT *, string_split(text, ' ') AS w FROM documents)
      SELECT doc_id, {_cut_sql("text", text.MAX_TEXT)} AS text,
        array_to_string([{_cut_sql("x", text.MAX_TEXT)} FOR x IN w[1:{text.MAX_LIST}]], ' ')
          || CASE WHEN len(w) > {text.MAX_LIST} THEN ' {{"omitted_items":' || (len(w) - {text.MAX_LIST}) || '}}' ELSE '' END
          AS words,
        least(doc_id % 100 + 1, {text.MAX_MAP} + 1) AS n_keys,
        CASE WHEN doc_id % 100 + 1 > {text.MAX_MAP} THEN doc_id % 100 + 1 - {text.MAX_MAP} END AS omitted_keys,
        source AS root_path, doc_id % 40 AS files, 1::BIGINT AS folders FROM w""",
    "reduced_messages": f"""SELECT conv_id AS run_id, turn, role AS type,
      {_cut_sql("text", text.MAX_MESSAGE)} AS text FROM conversations""",
    "registry_merge": """WITH b AS (SELECT 0 AS side, o_orderkey AS position, o_totalprice AS value, * FROM orders
        UNION ALL SELECT 1, o_orderkey, -o_totalprice, * FROM orders WHERE o_orderstatus = 'F'),
      k AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'id:' || o_custkey WHEN '2-HIGH' THEN 'origin:in/' || o_custkey
        WHEN '5-LOW' THEN NULL ELSE 'path:out/' || o_custkey END AS key, side * 1000000000 + position AS spot FROM b)
      SELECT key, arg_max(value, spot) AS value, arg_min(side, spot)::BIGINT AS side, arg_min(position, spot) AS position
        FROM k WHERE key IS NOT NULL GROUP BY key
      UNION ALL SELECT key, value, side, position FROM k WHERE key IS NULL""",
    "lineage": """WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_size > 3 AND p_partkey > 0
        THEN p_partkey // 2 END AS parent FROM part),
      up AS (SELECT id, id AS spot, 0::BIGINT AS depth FROM p
        UNION ALL SELECT up.id, p.parent, depth + 1 FROM up JOIN p ON p.id = up.spot WHERE p.parent IS NOT NULL)
      SELECT id, arg_max(spot, depth) AS root, max(depth) AS depth FROM up GROUP BY id""",
}
