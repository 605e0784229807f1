"""Artifact registry: merging and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.operators.ordered import salted_lookup
from voxtrace.session import stage


def registry_key() -> Column:
    """Identity of an artifact: its id, else its origin, else its path."""
    def named(prefix: str, column: str) -> Column:
        return F.when(F.col(column) != "", F.concat(F.lit(f"{prefix}:"), column))

    return F.coalesce(named("id", "id"), named("origin", "origin_path"), named("path", "path"))


def merge_registries(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right replaces left under the same key and keeps its place; unkeyed rows all stay.

    Both sides have id, origin_path, path, value and position.
    """
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    keyed = both.withColumn("key", registry_key())
    at = F.struct("side", "position")
    merged = (
        keyed.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max_by("value", at).alias("value"), F.min(at).alias("place"))
    )
    unkeyed = keyed.where(F.col("key").isNull()).select("key", "value", at.alias("place"))
    return merged.unionByName(unkeyed).select("key", "value", "place.side", "place.position")


def link_parents(artifacts: DataFrame) -> DataFrame:
    """(id, path, parent): the id of the artifact whose path was the input, if it is known."""
    known = artifacts.groupBy("path").agg(F.min("id").alias("parent")).withColumnRenamed(
        "path", "input_path"
    )
    return salted_lookup(artifacts, known, ["input_path"], ["id"], "left").select(
        "id", "path", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent")
    )


def lineage(linked: DataFrame) -> DataFrame:
    """(id, root, depth): every artifact's first ancestor, by doubling the known distance.

    Each round joins known jumps with known jumps, so a chain of n steps takes log n rounds.
    Artifacts that are in a cycle of parents, or descend from one, have no first ancestor: root
    and depth are null. They are what still moves once a jump is longer than all artifacts.
    """
    current = stage(
        linked.select(
            "id", F.coalesce("parent", "id").alias("root"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        ),
        "lineage",
    )
    longest, step = current.count(), 1
    while True:
        jump = current.select(
            F.col("id").alias("root"), F.col("root").alias("_up"), F.col("depth").alias("_more")
        )
        current = stage(
            salted_lookup(current, jump, ["root"], ["id"]).select(
                "id", F.col("_up").alias("root"), (F.col("depth") + F.col("_more")).alias("depth"),
                (F.col("_more") > 0).alias("_moved"),
            ),
            "lineage",
        )
        step *= 2
        if step > longest:
            endless = F.col("depth") >= longest
            return current.select(
                "id",
                F.when(~endless, F.col("root")).alias("root"),
                F.when(~endless, F.col("depth")).alias("depth"),
            )
        moved = not current.where("_moved").isEmpty()
        current = current.drop("_moved")
        if not moved:
            return current
