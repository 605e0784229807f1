"""The run index as JSON lines: one line per run with its ids, counts and all routes in order.

A run may hold any number of routes, so its line is never built as one value. It is cut into
parts (a head, stretches of routes, a tail) that are made apart and written one after the other;
the part behind another one is set off by a space, which JSON allows between its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtrace.operators.traces import route_segments, run_index

# Names that stand in for a missing test or session, and the length of a test name.
NO_TEST, NO_SESSION, TEST_NAME_CHARS = "_ungrouped", "no_session", 120
LINE_SCHEMA = (
    "run_id bigint, test_name string, session_id string, session_path string, started_at string, "
    "started_at_unix double, ended_at string, ended_at_unix double, tool_call_count bigint, "
    "successful_tool_calls bigint, failed_tool_calls bigint, routes array<string>, run_file string"
)


def line_heads(events: DataFrame, sessions: DataFrame, base: str) -> DataFrame:
    """All fields of a line but its routes, one row per run.

    ``sessions`` holds (run_id, test_name, session_id, session_path), one row per run. A run
    without events has counts of 0 and null times; one without a session has null ids and lies in
    the folder for runs without one. A test's name keeps letters, digits, ``.``, ``_`` and ``-``;
    each run of other characters becomes one ``_``.
    """
    counts = run_index(events).select(
        "run_id", "started_at", "ended_at", "tool_call_count", "successful_tool_calls", "failed_tool_calls"
    )
    given = sessions.select("run_id", "test_name", "session_id", "session_path")
    name = F.substring(F.regexp_replace(F.trim("test_name"), r"[^A-Za-z0-9._-]+", "_"), 1, TEST_NAME_CHARS)
    whole = given.join(counts, "run_id", "full").withColumn(
        "test_name", F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(NO_TEST)
    )
    folder = F.when(F.coalesce("session_id", F.lit("")) != "", F.col("session_id")).otherwise(NO_SESSION)

    def seconds(time: str):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {time})") / 1e6

    return whole.select(
        "run_id", "test_name", "session_id", "session_path",
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("started_at"),
        seconds("started_at").alias("started_at_unix"),
        F.date_format("ended_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ended_at"),
        seconds("ended_at").alias("ended_at_unix"),
        *[
            F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
            for c in ("tool_call_count", "successful_tool_calls", "failed_tool_calls")
        ],
        F.concat_ws("/", F.lit(base), "test_name", folder, F.concat("run_id", F.lit(".json"))).alias("run_file"),
    )


def line_parts(events: DataFrame, sessions: DataFrame, base: str) -> DataFrame:
    """(run_id, kind, segment, value): the text of every line, head, routes and tail apart."""
    heads = line_heads(events, sessions, base)
    fields = [F.col(c) for c in heads.columns if c != "run_file"]
    opened = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    file = F.to_json(F.struct("run_file"))
    none = F.lit(-1).cast("bigint")
    ends = heads.select("run_id", opened.alias("_open"), file.alias("_file")).select(
        "run_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit(0).alias("kind"),
                    F.concat(F.expr("left(_open, length(_open) - 1)"), F.lit(',"routes":[')).alias("value"),
                ),
                F.struct(
                    F.lit(2).alias("kind"),
                    F.concat(F.lit("],"), F.expr("substring(_file, 2)"), F.lit("\n")).alias("value"),
                ),
            )
        ).alias("_part"),
    ).select("run_id", "_part.kind", none.alias("segment"), "_part.value")
    listed = F.to_json("routes")
    routes = route_segments(events).select(
        "run_id",
        F.lit(1).alias("kind"),
        "segment",
        F.concat(
            F.when(F.col("segment") > 0, ",").otherwise(""), F.substr(listed, F.lit(2), F.length(listed) - 2)
        ).alias("value"),
    )
    return ends.unionByName(routes)


def write_lines(parts: DataFrame, folder: str) -> None:
    """Append the lines to a folder of text files.

    A line can't cross files, so one task writes a run; it sorts the parts on disk where they
    don't fit and holds one of them at a time.
    """
    (
        parts.repartition("run_id")
        .sortWithinPartitions("run_id", "kind", "segment")
        .select("value")
        .write.mode("append")
        .option("lineSep", " ")
        .text(folder)
    )


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines back as rows; here each run is one row, so its routes must fit in one."""
    return spark.read.schema(LINE_SCHEMA).json(folder)
