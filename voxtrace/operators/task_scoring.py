"""Rubric sections scored for many runs at once, each run by the specification of its own task.

``runs`` has run_id and task_id, ``specs`` one row per task. Every run gets a row, also one without
any event, call or file. A section without constraints is ``skipped`` with all its points. Counts
per (run, name) come before runs meet their specifications, so a long run is reduced map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.operators.ordered import salted_lookup
from voxtrace.operators.traces import INFRASTRUCTURE_TOOLS, ORDER, canonical_tool

SANDBOX_ROUTE = "code_sandbox"


def _names(column: str) -> Column:
    return F.coalesce(F.array_distinct(column), F.array().cast("array<string>"))


def _with_spec(runs: DataFrame, specs: DataFrame) -> DataFrame:
    return runs.join(specs, "task_id", "left")


def _status(skipped: Column, passed: Column) -> Column:
    return F.when(skipped, "skipped").when(passed, "passed").otherwise("failed")


def score_routing(runs: DataFrame, specs: DataFrame, events: DataFrame) -> DataFrame:
    """A1 first route, A2 nothing forbidden, A3 nothing repeated, A4 nothing missing, status.

    ``specs``: task_id, primary (text or null), necessary and forbidden (arrays). ``events``:
    run_id, ts, event_id, route. A3 costs its point but never fails the section.
    """
    per_route = events.groupBy("run_id", "route").agg(
        F.count("*").alias("_n"), F.min(F.struct(*ORDER)).alias("_at")
    )
    wanted = _with_spec(runs.select("run_id", "task_id"), specs).select(
        "run_id",
        "task_id",
        F.nullif("primary", F.lit("")).alias("primary"),
        _names("necessary").alias("necessary"),
        _names("forbidden").alias("forbidden"),
    )
    seen = (
        per_route.join(wanted, "run_id")
        .groupBy("run_id")
        .agg(
            F.min_by("route", "_at").alias("first_route"),
            F.count_if(F.array_contains("necessary", F.col("route"))).alias("_present"),
            F.count_if(F.array_contains("forbidden", F.col("route"))).alias("_banned"),
            F.max("_n").alias("_most"),
        )
    )
    zero = F.lit(0)
    first = F.col("primary").isNull() | F.coalesce(F.col("first_route") == F.col("primary"), F.lit(False))
    skipped = F.col("primary").isNull() & (F.size("necessary") == 0) & (F.size("forbidden") == 0)
    points = {
        "a1_primary": first,
        "a2_none_forbidden": F.coalesce("_banned", zero) == 0,
        "a3_none_repeated": F.coalesce("_most", zero) <= 1,
        "a4_required_present": F.coalesce("_present", zero) == F.size("necessary"),
    }
    passed = points["a1_primary"] & points["a2_none_forbidden"] & points["a4_required_present"]
    return wanted.join(seen, "run_id", "left").select(
        "run_id",
        "task_id",
        "first_route",
        *[(skipped | c).alias(name) for name, c in points.items()],
        _status(skipped, passed).alias("status"),
    )


def _slice_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls sorted by (run_id, order) become one row a run: the end place for each start place.

    ``waiting[k]`` holds the start places from which the sequence has been followed up to item k,
    so a call moves those that wait for its tool, and each of them one item on.
    """
    run = places = waiting = None

    def ends() -> pa.RecordBatch:
        out = np.empty(len(waiting), np.int32)
        for at, starts in enumerate(waiting):
            out[starts] = at
        return pa.RecordBatch.from_arrays(
            [pa.array([run]), pa.array([number], pa.int32()), pa.array([out.tolist()], pa.list_(pa.int32()))],
            ["run_id", "_slice", "_ends"],
        )

    for batch in batches:
        number = batch.column("_slice")[0].as_py() if len(batch) else None
        tools, sequences = batch.column("tool").to_pylist(), batch.column("sequence")
        for i, own in enumerate(batch.column("run_id").to_pylist()):
            if own != run:
                if run is not None:
                    yield ends()
                run, sequence = own, sequences[i].as_py()
                places, waiting = {}, [[k] for k in range(len(sequence) + 1)]
                for k in range(len(sequence) - 1, -1, -1):
                    places.setdefault(sequence[k], []).append(k)
            # from the last item to the first, so that no start place moves twice
            for k in places.get(tools[i], ()):
                if waiting[k]:
                    waiting[k + 1] = waiting[k] + waiting[k + 1]
                    waiting[k] = []
    if run is not None:
        yield ends()


def sequences_found(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, found): whether each run's ``sequence`` of tools occurs in order, gaps allowed.

    Following a sequence through a slice of the calls maps the item it waits for before the slice
    to the one it waits for behind it. Calls are range-partitioned by (run_id, order), so a long
    run is spread over slices; each slice gives one such map a run, and the maps are applied one
    after the other. One pass, whatever the length of the sequence.
    """
    wanted = runs.where(F.size("sequence") > 0).select("run_id", "sequence")
    # only calls of tools in the sequence can move it
    near = salted_lookup(calls.select("run_id", *ORDER, "tool"), wanted, ["run_id"], list(ORDER))
    near = near.where(F.array_contains("sequence", F.col("tool")))
    sliced = (
        near.repartitionByRange("run_id", *ORDER)
        .sortWithinPartitions("run_id", *ORDER)
        .select("run_id", "tool", "sequence", F.spark_partition_id().alias("_slice"))
    )
    run_type = runs.schema["run_id"].dataType.simpleString()
    maps = sliced.mapInArrow(_slice_maps, f"run_id {run_type}, _slice int, _ends array<int>")
    reached = maps.groupBy("run_id").agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("_slice", "_ends"))),
            F.lit(0),
            lambda at, s: F.element_at(s["_ends"], at + 1),
        ).alias("_reached")
    )
    return runs.join(reached, "run_id", "left").select(
        "run_id", (F.coalesce("_reached", F.lit(0)) == F.size("sequence")).alias("found")
    )


def score_tools(runs: DataFrame, specs: DataFrame, calls: DataFrame, events: DataFrame) -> DataFrame:
    """C1 right tools, C2 right order, C3 sandbox used at most once or avoided, status.

    ``runs`` also has sandbox_attempts. ``specs``: task_id, expected, forbidden, sequence (arrays),
    exact_set, requires_sandbox (booleans or null). ``calls``: run_id, ts, event_id, tool, success,
    flagged; calls without a flag only count in runs where no call has one. The sandbox counts as
    used where it is among the routes of ``events``.
    """
    wanted = _with_spec(runs.select("run_id", "task_id", "sandbox_attempts"), specs)
    spec = ["expected", "forbidden", "sequence"]
    wanted = wanted.select(
        "run_id",
        "task_id",
        F.coalesce("sandbox_attempts", F.lit(0)).alias("sandbox_attempts"),
        *[F.coalesce(F.filter(F.transform(c, canonical_tool), lambda x: x.isNotNull()), F.array().cast("array<string>")).alias(c) for c in spec],
        F.coalesce("exact_set", F.lit(False)).alias("exact_set"),
        "requires_sandbox",
    )
    # a flag that is missing is no flag
    calls = calls.withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    named = calls.withColumn("tool", canonical_tool(F.col("tool"))).where(F.col("tool").isNotNull())
    named = named.where(~F.col("tool").isin(INFRASTRUCTURE_TOOLS))
    good = ~F.col("success").eqNullSafe(False)
    # flagged and other calls side by side; a run takes the first kind if it has any
    any_flag = calls.groupBy("run_id").agg(F.max("flagged").alias("_any"))
    per_tool = named.groupBy("run_id", "tool", "flagged").agg(F.count("*").alias("_n"), F.max(good).alias("_good"))
    counted = (
        per_tool.join(any_flag, "run_id")
        .where(F.col("flagged") | ~F.col("_any"))
        .join(wanted, "run_id")
        .groupBy("run_id")
        .agg(
            F.count_distinct(F.when(F.array_contains("expected", F.col("tool")) & F.col("_good"), F.col("tool"))).alias("_found"),
            F.sum(F.when(F.array_contains("forbidden", F.col("tool")), F.col("_n")).otherwise(0)).alias("_banned"),
            F.sum(F.when(~F.array_contains("expected", F.col("tool")), F.col("_n")).otherwise(0)).alias("_other"),
        )
    )
    usable = named.where(good).join(any_flag, "run_id").where(F.col("flagged") | ~F.col("_any"))
    order = sequences_found(wanted.select("run_id", "sequence"), usable)
    sandbox = events.where(F.col("route") == SANDBOX_ROUTE).select("run_id").distinct().withColumn("_sandbox", F.lit(True))
    zero = F.lit(0)
    used = F.coalesce("_sandbox", F.lit(False))
    some = (F.size("expected") > 0) | (F.size("forbidden") > 0) | (F.size("sequence") > 0)
    unexpected = F.when(F.size("expected") > 0, F.coalesce("_other", zero)).otherwise(0).cast("bigint")
    first = (
        (F.coalesce("_found", zero) == F.size(F.array_distinct("expected")))
        & (F.coalesce("_banned", zero) == 0)
        & (~F.col("exact_set") | (unexpected == 0))
    )
    third = F.when(F.col("requires_sandbox"), used & (F.col("sandbox_attempts") <= 1)).when(
        ~F.col("requires_sandbox"), ~used
    ).otherwise(True)
    skipped = ~some & F.col("requires_sandbox").isNull()
    passed = F.when(some, first & F.col("found")).otherwise(third)
    return (
        wanted.join(counted, "run_id", "left")
        .join(order, "run_id")
        .join(sandbox, "run_id", "left")
        .select(
            "run_id",
            "task_id",
            unexpected.alias("unexpected_calls"),
            (skipped | first).alias("c1_tools"),
            (skipped | F.col("found")).alias("c2_order"),
            (skipped | third).alias("c3_sandbox"),
            _status(skipped, passed).alias("status"),
        )
    )


def score_artifacts(runs: DataFrame, specs: DataFrame, files: DataFrame) -> DataFrame:
    """D1 any file, D2 every extension group has enough, D3 the same among registered, status.

    ``specs``: task_id, requires (boolean or null), groups (array of struct extensions, min_count).
    ``files``: run_id, path, registered. Null skips the section, false gives all points.
    """
    wanted = _with_spec(runs.select("run_id", "task_id"), specs)
    owned = files.select("run_id", F.lower("path").alias("_path"), "registered")
    totals = owned.groupBy("run_id").agg(
        F.count("*").alias("_files"), F.count_if("registered").alias("_registered")
    )
    fits = F.exists("extensions", lambda e: F.col("_path").endswith(F.lower(e)))
    groups = wanted.select("run_id", F.posexplode("groups").alias("_group", "_spec")).select(
        "run_id", "_group", "_spec.extensions", F.coalesce("_spec.min_count", F.lit(0)).alias("least")
    )
    matched = (
        owned.join(groups, "run_id")
        .where(fits)
        .groupBy("run_id", "_group")
        .agg(F.count("*").alias("_n"), F.count_if("registered").alias("_r"))
    )
    zero = F.lit(0)
    enough = (
        groups.join(matched, ["run_id", "_group"], "left")
        .groupBy("run_id")
        .agg(
            F.bool_and(F.coalesce("_n", zero) >= F.col("least")).alias("_types"),
            F.bool_and(F.coalesce("_r", zero) >= F.col("least")).alias("_registered_types"),
        )
    )
    some = F.coalesce("_files", zero) > 0
    free = F.col("requires").isNull() | ~F.col("requires")
    points = {
        "d1_created": some,
        "d2_types": some & F.coalesce("_types", F.lit(True)),
        "d3_registered": some & (F.coalesce("_registered", zero) > 0) & F.coalesce("_registered_types", F.lit(True)),
    }
    passed = free | (points["d1_created"] & points["d2_types"] & points["d3_registered"])
    return (
        wanted.join(totals, "run_id", "left")
        .join(enough, "run_id", "left")
        .select(
            "run_id",
            "task_id",
            *[(free | c).alias(name) for name, c in points.items()],
            _status(F.col("requires").isNull(), passed).alias("status"),
        )
    )


#: Distinct rule texts of a specification table, whose expressions are built on the driver.
RULE_TEXTS = 10_000


def rules_by_task(answers: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """(keys, task_id, rule, passed, error): each row of ``answers`` by the rules of its task.

    ``rules``: task_id, rule, text; the text is an SQL boolean over the columns of ``answers``.
    A rule fails alone: one that cannot be analysed fails everywhere and says why in ``error``,
    and one that has no truth value in a row, or would raise there, fails in that row.
    """
    spark = answers.sparkSession
    texts = [r[0] for r in rules.select("text").distinct().orderBy("text").limit(RULE_TEXTS + 1).collect()]
    if len(texts) > RULE_TEXTS:
        raise ValueError(f"More than {RULE_TEXTS} rule texts")
    reasons = {}
    for text in texts:
        try:
            answers.select(F.expr(text if text is not None else "(").cast("boolean"))
        except (AnalysisException, ParseException) as error:
            reasons[text] = f"{type(error).__name__}: {str(error).splitlines()[0]}"
    usable = [t for t in texts if t not in reasons]
    failed = F.coalesce(*[F.when(F.col("text").eqNullSafe(t), F.lit(r)) for t, r in reasons.items()], F.lit(None).cast("string"))
    number = F.coalesce(*[F.when(F.col("text") == t, F.lit(k)) for k, t in enumerate(usable)], F.lit(-1))
    asked = rules.select(F.col("task_id").alias("_of"), F.col("rule").alias("_name"), number.alias("_k"), failed.alias("_why"))
    met = answers.join(asked, F.col("task_id") == F.col("_of"))
    # without ANSI an operation that would raise gives null; expressions keep the mode they are analysed in
    setting = "spark.sql.ansi.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        holds = F.coalesce(*[F.when(F.col("_k") == k, F.expr(t).cast("boolean")) for k, t in enumerate(usable)], F.lit(False))
        return met.select(
            *keys, "task_id", F.col("_name").alias("rule"), holds.alias("passed"), F.col("_why").alias("error")
        )
    finally:
        spark.conf.set(setting, before)
