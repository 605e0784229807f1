"""Checks and roll-ups over run traces: routes, tools, artifacts, messages.

A run may be as long as a third of all events, so nothing here gathers a run into one array or
one window. Order is always explicit: the pair (ts, event_id), or the turn of a message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.operators.ordered import carry_forward, row_numbers, salted_lookup
from voxtrace.session import stage

ORDER = ["ts", "event_id"]
# Tools that do not count, and a prefix that is not part of a tool's name.
INFRASTRUCTURE_TOOLS = ["create_session"]
TOOL_PREFIX = "main_graph_tool_"
SEGMENT = 1000  # routes per row of the run index


def run_index(events: DataFrame) -> DataFrame:
    """One row per run: start, end, calls, successful and failed calls, distinct routes."""
    return events.groupBy("run_id").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count("*").alias("tool_call_count"),
        F.count_if("success").alias("successful_tool_calls"),
        F.count_if(~F.col("success")).alias("failed_tool_calls"),
        F.min_by("route", F.struct(*ORDER)).alias("first_route"),
        F.max_by("route", F.struct(*ORDER)).alias("last_route"),
    )


def route_segments(events: DataFrame) -> DataFrame:
    """Routes of every run in order, as arrays (run_id, segment, routes) of a bounded length."""
    placed = row_numbers(events.select("run_id", "route", *ORDER), ["run_id"], ORDER, "_n")
    segment = F.floor((F.col("_n") - 1) / SEGMENT).cast("bigint")
    return placed.groupBy("run_id", segment.alias("segment")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "route"))), lambda r: r["route"]).alias("routes")
    )


def ordered_routes(events: DataFrame) -> DataFrame:
    """Routes of every run in order, as text, in segments of a bounded number of routes.

    Short runs have one segment; a long run goes on in the next rows, and nothing is left out.
    ``run_lines`` writes them as one line per run.
    """
    return route_segments(events).select(
        "run_id",
        "segment",
        F.size("routes").cast("bigint").alias("routes"),
        F.array_join("routes", ",").alias("route_list"),
    )


def route_checks(
    events: DataFrame,
    expected_primary: str | None,
    necessary: Sequence[str] = (),
    forbidden: Sequence[str] = (),
) -> DataFrame:
    """A1 first route, A2 nothing forbidden, A3 nothing repeated, A4 nothing missing.

    A3 costs its point but never fails the section. Counts per (run, route) come first, so a
    long run is reduced before runs meet.
    """
    per_route = events.groupBy("run_id", "route").agg(
        F.count("*").alias("_n"), F.min(F.struct(*ORDER)).alias("_at")
    )
    present = F.count_if(F.col("route").isin(list(necessary))) if necessary else F.lit(0)
    banned = F.count_if(F.col("route").isin(list(forbidden))) if forbidden else F.lit(0)
    # At most one entry per distinct route name.
    repeated = F.array_join(
        F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.col("route")))), ","
    )
    checked = per_route.groupBy("run_id").agg(
        F.min_by("route", "_at").alias("first_route"),
        (present == len(set(necessary))).alias("a4_required_present"),
        (banned == 0).alias("a2_none_forbidden"),
        (F.max("_n") <= 1).alias("a3_none_repeated"),
        repeated.alias("repeated_routes"),
    )
    primary = F.lit(True) if expected_primary is None else F.col("first_route") == expected_primary
    passed = F.col("a1_primary") & F.col("a2_none_forbidden") & F.col("a4_required_present")
    return checked.withColumn("a1_primary", primary).withColumn(
        "status", F.when(passed, "passed").otherwise("failed")
    )


def repeated_tasks(requests: DataFrame) -> DataFrame:
    """Second and later identical (route, task) requests of a run."""
    return row_numbers(
        requests, ["run_id", "route", "task"], ORDER, "occurrence"
    ).where("occurrence > 1")


def judge_verdict(score: Column) -> tuple[Column, Column]:
    """Normalised score and status of a judge's 1..5 verdict; 3 or more passes."""
    valid = score.between(1, 5)
    normal = F.when(valid, F.bround((score - 1) / 4, 4))
    status = (
        F.when(~F.coalesce(valid, F.lit(False)), "not_evaluated")
        .when(score >= 3, "passed")
        .otherwise("failed")
    )
    return normal, status


def canonical_tool(name: Column) -> Column:
    """Name without surrounding blanks and the main graph's prefix; null if nothing is left."""
    plain = F.regexp_extract(name, rf"(?s)^\s*(?:{TOOL_PREFIX})?(.*?)\s*$", 1)
    return F.nullif(plain, F.lit(""))


def in_order(
    events: DataFrame, runs: DataFrame, item: str, needle: Sequence[str]
) -> DataFrame:
    """Whether the items of ``needle`` occur in order, gaps allowed: (run_id, found).

    The earliest place of each item after the place of the one before is a partial minimum,
    so one pass per needle item suffices and no run is ever sorted.
    """
    reached = None
    for wanted in needle:
        hits = events.where(F.col(item) == wanted).select("run_id", F.struct(*ORDER).alias("_at"), "event_id")
        if reached is not None:
            hits = salted_lookup(hits, reached, ["run_id"], ["event_id"]).where("_at > _reached")
        reached = hits.groupBy("run_id").agg(F.min("_at").alias("_reached"))
    if reached is None:
        return runs.select("run_id").distinct().withColumn("found", F.lit(True))
    return (
        runs.select("run_id")
        .distinct()
        .join(reached, "run_id", "left")
        .select("run_id", F.col("_reached").isNotNull().alias("found"))
    )


def tool_checks(
    calls: DataFrame,
    expected: Sequence[str] = (),
    forbidden: Sequence[str] = (),
    sequence: Sequence[str] = (),
    exact_set: bool = False,
    sandbox: str = "code_sandbox",
    requires_sandbox: bool | None = None,
) -> DataFrame:
    """C1 right tools, C2 right order, C3 sandbox used at most once or avoided.

    ``calls`` has run_id, event_id, ts, tool, success and flagged (whether the call recorded
    its success). Calls without a flag only count in runs where no call has one.
    """
    named = calls.withColumn("tool", canonical_tool(F.col("tool"))).where(
        F.col("tool").isNotNull()
    )
    runs = named.groupBy("run_id").agg(F.max("flagged").alias("_any"))
    # Staged, since the tool counts and every item of the sequence read it.
    counted = stage(
        salted_lookup(named, runs, ["run_id"], ["event_id"])
        .where(F.col("flagged") | ~F.col("_any"))
        .where(~F.col("tool").isin(INFRASTRUCTURE_TOOLS))
        .select(
            "run_id", *ORDER, "tool", (~F.col("success").eqNullSafe(False)).alias("_good")
        ),
        "tool-calls",
    )
    per_tool = counted.groupBy("run_id", "tool").agg(
        F.count("*").alias("_n"), F.max("_good").alias("_good")
    )
    tool = F.col("tool")
    wanted, banned = sorted(set(expected)), sorted(set(forbidden))
    judged = per_tool.groupBy("run_id").agg(
        F.count_if(tool.isin(wanted) & F.col("_good")).alias("expected_found"),
        F.coalesce(F.sum(F.when(tool.isin(banned), F.col("_n"))), F.lit(0)).alias("forbidden_calls"),
        F.coalesce(F.sum(F.when(~tool.isin(wanted), F.col("_n"))), F.lit(0)).alias("unexpected_calls"),
        F.coalesce(F.sum(F.when(tool == sandbox, F.col("_n"))), F.lit(0)).alias("sandbox_calls"),
    )
    ordered = in_order(counted.where("_good"), runs, "tool", sequence)
    used = F.col("sandbox_calls") > 0
    third = F.lit(True)
    if requires_sandbox is True:
        third = used & (F.col("sandbox_calls") <= 1)
    elif requires_sandbox is False:
        third = ~used
    first = (F.col("expected_found") == len(wanted)) & (F.col("forbidden_calls") == 0)
    if exact_set and wanted:
        first = first & (F.col("unexpected_calls") == 0)
    zero = F.lit(0).cast("bigint")
    joined = runs.select("run_id").join(judged, "run_id", "left").join(ordered, "run_id")
    for c in ("expected_found", "forbidden_calls", "unexpected_calls", "sandbox_calls"):
        joined = joined.withColumn(c, F.coalesce(c, zero))
    constrained = bool(wanted or banned or sequence)
    checked = joined.select(
        "run_id",
        "expected_found",
        "forbidden_calls",
        "unexpected_calls",
        first.alias("c1_tools"),
        F.col("found").alias("c2_order"),
        third.alias("c3_sandbox"),
    )
    passed = (F.col("c1_tools") & F.col("c2_order")) if constrained else F.col("c3_sandbox")
    return checked.withColumn("status", F.when(passed, "passed").otherwise("failed"))


def artifact_checks(
    files: DataFrame, groups: Sequence[tuple[Sequence[str], int]], required: bool = True
) -> DataFrame:
    """D1 any file, D2 every extension group has enough files, D3 the same among registered.

    ``files`` has run_id, path and registered. Without a requirement every point is given.
    """
    path = F.lower("path")
    aggregates = [F.count("*").alias("files"), F.count_if("registered").alias("registered_files")]
    for i, (extensions, _) in enumerate(groups):
        fits = F.lit(False)
        for e in extensions:
            fits = fits | path.endswith(e.lower())
        aggregates += [
            F.count_if(fits).alias(f"group_{i}"),
            F.count_if(fits & F.col("registered")).alias(f"registered_{i}"),
        ]
    counted = files.groupBy("run_id").agg(*aggregates)
    enough, enough_registered = F.lit(True), F.col("registered_files") > 0
    for i, (_, least) in enumerate(groups):
        enough = enough & (F.col(f"group_{i}") >= least)
        enough_registered = enough_registered & (F.col(f"registered_{i}") >= least)
    if not required:
        enough = enough_registered = F.lit(True)
    any_file = F.lit(True) if not required else F.col("files") > 0
    return counted.select(
        "*",
        any_file.alias("d1_created"),
        enough.alias("d2_types"),
        enough_registered.alias("d3_registered"),
    ).withColumn(
        "status",
        F.when(F.col("d1_created") & F.col("d2_types") & F.col("d3_registered"), "passed").otherwise(
            "failed"
        ),
    )


def unique_calls(calls: DataFrame) -> DataFrame:
    """First call of every (run, id, name, kind), by source and position."""
    return calls.groupBy("run_id", "call_id", "name", "kind").agg(
        F.min(F.struct("source", "position")).alias("_first"), F.count("*").alias("seen")
    ).select("run_id", "call_id", "name", "kind", "_first.source", "_first.position", "seen")


def unique_artifacts(found: DataFrame, keep: str = "first") -> DataFrame:
    """One row per path: the first or the last one found, by (source, position)."""
    at = F.struct("source", "position")
    chosen = F.min(at) if keep == "first" else F.max(at)
    return found.groupBy("path").agg(chosen.alias("_at"), F.count("*").alias("seen")).select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        "_at.source",
        "_at.position",
        "seen",
    )


def split_messages(visible: DataFrame, internal: DataFrame) -> DataFrame:
    """Visible messages, and internal ones whose (type, text) is not visible in the run."""
    hidden = internal.join(
        visible.select("run_id", "type", "text").distinct(), ["run_id", "type", "text"], "left_anti"
    )
    return visible.withColumn("visibility", F.lit("visible")).unionByName(
        hidden.withColumn("visibility", F.lit("internal"))
    )


def assign_to_routes(routes: DataFrame, tools: DataFrame) -> DataFrame:
    """Route of every tool event: (run_id, event_id, key, route_event_id or null).

    An event belongs to the latest route at or before it, if that route has the event's key;
    the next route of the run, whatever its key, ends the interval.
    """
    both = routes.select(
        "run_id", "ts", "event_id", "key", F.lit(0).alias("kind"), F.col("success"), F.col("tool")
    ).unionByName(
        tools.select(
            "run_id", "ts", "event_id", "key", F.lit(1).alias("kind"), F.col("success"), F.col("tool")
        )
    )
    marked = both.withColumn(
        "_open", F.when(F.col("kind") == 0, F.struct(F.col("event_id").alias("id"), "key"))
    )
    carried = carry_forward(marked, ["run_id"], ["ts", "kind", "event_id"], "_open", "_route")
    same = F.col("_route.key") == F.col("key")
    return carried.where("kind = 1").select(
        "run_id", "event_id", "key", "tool", "success",
        F.when(same, F.col("_route.id")).alias("route_event_id"),
    )


def sub_runs(routes: DataFrame, tools: DataFrame) -> DataFrame:
    """Every route as a sub-run: n-th call of its key, tools used, events and status.

    A route without events of its own takes all events of its key in the run; those are
    summed per (run, key) once and never listed per route.
    """
    assigned = assign_to_routes(routes, tools)
    failed = F.count_if(F.col("success").eqNullSafe(False))
    # Distinct tool names only: a bounded vocabulary.
    names = F.array_join(F.sort_array(F.collect_set("tool")), ",")
    own = (
        assigned.where(F.col("route_event_id").isNotNull())
        .groupBy(F.col("route_event_id").alias("event_id"))
        .agg(F.count("*").alias("own_n"), failed.alias("own_failed"), names.alias("own_tools"))
    )
    of_key = assigned.groupBy("run_id", "key").agg(
        F.count("*").alias("key_n"), failed.alias("key_failed"), names.alias("key_tools")
    )
    placed = row_numbers(routes.select("run_id", "key", "event_id", "ts"), ["run_id", "key"], ORDER, "call_index")
    joined = salted_lookup(placed.join(own, "event_id", "left"), of_key, ["run_id", "key"], ["event_id"], "left")
    has_own = F.col("own_n").isNotNull()
    return joined.select(
        "run_id",
        "key",
        "event_id",
        "call_index",
        F.when(has_own, "interval").otherwise("key").alias("assigned_by"),
        F.coalesce("own_n", "key_n", F.lit(0).cast("bigint")).alias("tool_events"),
        F.coalesce("own_tools", "key_tools", F.lit("")).alias("tool_names"),
        F.when(F.coalesce("own_failed", "key_failed", F.lit(0)) > 0, "failed")
        .otherwise("completed")
        .alias("status"),
    )


def run_status(events: DataFrame, errors: DataFrame) -> DataFrame:
    """error, completed_with_tool_errors or completed per run."""
    tools = events.groupBy("run_id").agg(
        F.count_if(F.col("success").eqNullSafe(False)).alias("failed_tools")
    )
    broken = errors.select("run_id").distinct().withColumn("_broken", F.lit(True))
    return tools.join(broken, "run_id", "left").select(
        "run_id",
        F.when(F.col("_broken"), "error")
        .when(F.col("failed_tools") > 0, "completed_with_tool_errors")
        .otherwise("completed")
        .alias("status"),
    )


def last_assistant_message(messages: DataFrame) -> DataFrame:
    kind = F.lower("type")
    return (
        messages.where(kind.contains("ai") | kind.contains("assistant"))
        .groupBy("run_id")
        .agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    )


CHARS_PER_TOKEN = 4  # fixed value


def token_estimate(messages: DataFrame, threshold: int) -> DataFrame:
    """Estimated tokens per run and whether its payload has to be reduced."""
    return (
        messages.groupBy("run_id")
        .agg(F.sum(F.length("text")).alias("chars"))
        .withColumn("tokens", F.ceil(F.col("chars") / CHARS_PER_TOKEN))
        .withColumn("reduce", F.col("tokens") > threshold)
    )


