"""Incremental run index: the same table as the batch one, kept by a streaming query.

Every micro-batch writes one partial row per run that it saw, in a folder named after the
batches it covers. Partial rows merge by sums and extremes, so nothing is remembered between
batches: a run may end, pause for days or get late events, and each event counts exactly once.
After every ``fanout``-th batch the folders of that stretch are merged into one, after every
``fanout``-th stretch the stretches, and so on; a reader meets at most ``fanout - 1`` folders
of each size, whatever the number of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = (
    "run_id bigint, event_id bigint, ts timestamp_ntz, route string, success boolean, args string"
)
PLACE = "struct<ts: timestamp_ntz, event_id: bigint, route: string>"
PARTIAL_SCHEMA = (
    "run_id bigint, started_at timestamp_ntz, ended_at timestamp_ntz, tool_call_count bigint, "
    f"successful_tool_calls bigint, failed_tool_calls bigint, first {PLACE}, last {PLACE}"
)
FANOUT = 8


def read_event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Trace events from JSON lines that are appended to a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def partial_index(events: DataFrame) -> DataFrame:
    """Calls per run, in a form that merges. An unknown success counts as neither."""
    place = F.struct("ts", "event_id", "route")
    return events.groupBy("run_id").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count("*").alias("tool_call_count"),
        F.count_if("success").alias("successful_tool_calls"),
        F.count_if(~F.col("success")).alias("failed_tool_calls"),
        F.min(place).alias("first"),
        F.max(place).alias("last"),
    )


def merge_partials(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        *[F.sum(c).alias(c) for c in ("tool_call_count", "successful_tool_calls", "failed_tool_calls")],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def stretch_after(number: int, fanout: int = FANOUT) -> tuple[int, int] | None:
    """First and last batch to merge once batch ``number`` is written: the longest that ends there."""
    size = 1
    while (number + 1) % (size * fanout) == 0:
        size *= fanout
    return (number + 1 - size, number) if size > 1 else None


def split_covered(
    stretches: list[tuple[int, int]],
) -> tuple[list[tuple[int, int]], list[tuple[tuple[int, int], int]]]:
    """Stretches to read, and those inside a longer one, with the last batch of that one."""
    live: list[tuple[int, int]] = []
    covered = []
    for first, last in sorted(set(stretches), key=lambda s: (s[0], -s[1])):
        if live and last <= live[-1][1]:
            covered.append(((first, last), live[-1][1]))
        else:
            live.append((first, last))
    return live, covered


def _path(spark: SparkSession, text: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)


def _file_system(spark: SparkSession, target: str):
    return _path(spark, target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folder(target: str, stretch: tuple[int, int]) -> str:
    return f"{target}/batches-{stretch[0]}-{stretch[1]}"


def written_stretches(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """Stretches whose folder was written to its end."""
    system = _file_system(spark, target)
    if not system.exists(_path(spark, target)):
        return []
    found = []
    for status in system.listStatus(_path(spark, target)):
        name = status.getPath().getName()
        if name.startswith("batches-") and system.exists(_path(spark, f"{target}/{name}/_SUCCESS")):
            _, first, last = name.split("-")
            found.append((int(first), int(last)))
    return found


def drop_covered(spark: SparkSession, target: str, number: int) -> None:
    """Delete folders that were merged by batches before ``number``.

    The merging batch itself may still be repeated, and then reads them again.
    """
    system = _file_system(spark, target)
    for stretch, end in split_covered(written_stretches(spark, target))[1]:
        if end < number:
            system.delete(_path(spark, _folder(target, stretch)), True)


def _read(spark: SparkSession, target: str, stretches: list[tuple[int, int]]) -> DataFrame:
    if not stretches:
        return spark.createDataFrame([], PARTIAL_SCHEMA)
    return spark.read.schema(PARTIAL_SCHEMA).parquet(*[_folder(target, s) for s in stretches])


def add_batch(events: DataFrame, target: str, number: int, fanout: int = FANOUT) -> None:
    """Write the partial rows of one batch and merge the stretch that it completes, if any.

    A batch that is repeated after a failure overwrites its own folder and its own merge, so the
    index stays right. The numbers are those of one checkpoint: a new one needs a new target.
    """
    spark = events.sparkSession
    drop_covered(spark, target, number)
    partial_index(events).write.mode("overwrite").parquet(_folder(target, (number, number)))
    whole = stretch_after(number, fanout)
    if whole:
        inside = [
            s for s in written_stretches(spark, target) if s != whole and whole[0] <= s[0] and s[1] <= whole[1]
        ]
        parts = _read(spark, target, split_covered(inside)[0])
        merge_partials(parts).write.mode("overwrite").parquet(_folder(target, whole))


def keep_index(
    events: DataFrame, target: str, checkpoint: str, fanout: int = FANOUT
) -> StreamingQuery:
    """Add every micro-batch of a stream to the index; ``latest_index`` reads it."""
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: add_batch(batch, target, number, fanout))
        .trigger(availableNow=True)
        .start()
    )


def latest_index(spark: SparkSession, target: str) -> DataFrame:
    """One row per run over all batches written so far.

    The folders are listed when this is called; a reader that still runs two merges later has to
    start again, since what it reads is deleted by then.
    """
    live, _ = split_covered(written_stretches(spark, target))
    merged = merge_partials(_read(spark, target, live))
    return merged.withColumns(
        {"first_route": F.col("first.route"), "last_route": F.col("last.route")}
    ).drop("first", "last")
