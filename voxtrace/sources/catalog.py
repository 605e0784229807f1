"""File catalogues: inventory, slice order, numbered runs and artifact registration.

A catalogue is a DataFrame with a path and a size; ``list_files`` builds one from a folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtrace.operators.ordered import row_numbers

MIN_RUN = 3  # fixed value: shortest run of numbered files that is folded


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of every file below a folder; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.col("length").alias("size"))
    )


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Last suffix in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def compound_extension(path: Column) -> Column:
    """All suffixes in lower case, as in ``.nii.gz``."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.]+((\.[^.]+)+)$", 1))


def matches_extension(path: Column, extensions: Sequence[str] | None) -> Column:
    if not extensions:
        return F.lit(True)
    wanted = [e.strip().lower() for e in extensions if e.strip()]
    wanted = [e if e.startswith(".") else f".{e}" for e in wanted]
    return extension(path).isin(wanted) | compound_extension(path).isin(wanted)


def file_inventory(
    files: DataFrame,
    extensions: Sequence[str] | None = None,
    max_depth: int | None = None,
    max_entries: int | None = None,
) -> DataFrame:
    """name, path, extension, depth, bytes and MB; in path order if the listing is capped."""
    path = F.col("path")
    listed = files.where(matches_extension(path, extensions)).select(
        base_name(path).alias("name"),
        "path",
        extension(path).alias("extension"),
        F.length(F.regexp_replace(path, "[^/]", "")).cast("bigint").alias("depth"),
        F.col("size").cast("bigint").alias("bytes"),
        F.round(F.col("size") / (1024 * 1024), 6).alias("megabytes"),
    )
    if max_depth is not None:
        listed = listed.where(F.col("depth") <= max_depth)
    if max_entries is not None:
        listed = listed.orderBy("path", "bytes").limit(max_entries)
    return listed


def inventory_totals(
    files: DataFrame, extensions: Sequence[str] | None = None, max_entries: int | None = None
) -> DataFrame:
    """File count and bytes over the listed entries, and whether the cap cut the listing."""
    matching = file_inventory(files, extensions)
    found = matching.agg(F.count("*").alias("matching"))
    totals = file_inventory(files, extensions, None, max_entries).agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_distinct("extension").alias("extensions"),
    )
    return totals.withColumn("truncated", F.col("files") < found.scalar())


def order_slices(files: DataFrame, group: str, name: str, mode: str = "auto") -> DataFrame:
    """Position of every slice file in its folder.

    Numeric order needs an index in every name; ``auto`` falls back to name order for a
    folder where one is missing. Repeated indices of a numeric folder are flagged.
    """
    if mode not in {"auto", "numeric", "lexicographic"}:
        raise ValueError(f"Unknown slice order {mode!r}")
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    digits = F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1))
    indexed = files.withColumn(
        "slice_index", F.try_element_at(digits, F.lit(-1)).try_cast("bigint")
    )
    if mode == "lexicographic":
        indexed = indexed.withColumn("slice_index", F.lit(None).cast("bigint"))
    folders = indexed.groupBy(group).agg(
        F.count_if(F.col("slice_index").isNull()).alias("unnumbered")
    )
    usable = indexed.join(folders, group).withColumn(
        "numeric", (F.col("unnumbered") == 0) if mode != "lexicographic" else F.lit(False)
    )
    usable = usable.withColumn(
        "_first", F.when(F.col("numeric"), F.col("slice_index")).otherwise(F.lit(-1))
    ).withColumn("_second", F.lower(name))
    repeated = (
        usable.where("numeric")
        .groupBy(group, "slice_index")
        .agg((F.count("*") > 1).alias("duplicate"))
    )
    placed = row_numbers(usable, [group], ["_first", "_second", name], "position")
    return placed.join(repeated, [group, "slice_index"], "left").select(
        group,
        name,
        F.when(F.col("numeric"), F.col("slice_index")).alias("slice_index"),
        "numeric",
        "position",
        F.coalesce("duplicate", F.lit(False)).alias("duplicate"),
        (F.lit(mode == "numeric") & (F.col("unnumbered") > 0)).alias("unnumbered_error"),
    )


def numbered_runs(files: DataFrame, group: str, name: str) -> DataFrame:
    """Fold consecutive numbered names of one folder into runs.

    Names belong together if prefix, suffix and digit width agree and numbers step by one.
    Runs of three or more are folded, shorter ones are listed as single files.
    """
    pattern = r"^(.*?)(\d+)(\D*)$"
    parts = files.select(
        group,
        name,
        F.regexp_extract(name, pattern, 1).alias("prefix"),
        F.regexp_extract(name, pattern, 2).alias("digits"),
        F.regexp_extract(name, pattern, 3).alias("suffix"),
    ).where(F.col("digits") != "")
    numbered = parts.withColumn("width", F.length("digits").cast("bigint")).withColumn(
        "number", F.col("digits").cast("bigint")
    )
    family = [group, "prefix", "suffix", "width"]
    ranked = row_numbers(numbered.drop("digits"), family, ["number"], "rn")
    return (
        ranked.groupBy(*family, (F.col("number") - F.col("rn")).alias("island"))
        .agg(
            F.min_by(name, "number").alias("first_name"),
            F.max_by(name, "number").alias("last_name"),
            F.count("*").alias("files"),
        )
        .select(
            group, "first_name", "last_name", "files", (F.col("files") >= MIN_RUN).alias("folded")
        )
    )


def register_artifacts(
    catalogue: DataFrame,
    requested: DataFrame,
    extensions: Sequence[str] | None,
    max_files: int | None = None,
    folder: str | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Requested paths, then matching folder files, unique by path, numbered in that order.

    ``requested`` may have a ``place``, the order of the request (else the paths' own order);
    ``catalogue`` may have ``is_file``, false for a path that is no file. Files come from ``folder``
    and from folders at most ``max_depth`` below it (0: none), or from the whole catalogue. Skipped rows
    are requested paths that do not exist (not_found) or are no files (not_a_file), a folder that does
    not exist (folder_not_found) or is a file (not_a_folder), and files behind the first ``max_files``
    (over_limit), if that is given.
    """
    is_file = F.coalesce("is_file", F.lit(True)) if "is_file" in catalogue.columns else F.lit(True)
    known = catalogue.groupBy("path").agg(F.max(is_file).alias("is_file"))
    files = known.where("is_file").select("path")
    place = F.col("place").cast("bigint") if "place" in requested.columns else F.lit(0).cast("bigint")
    asked = requested.groupBy("path").agg(F.min(place).alias("place"))
    none = F.lit(None).cast("bigint")
    missing = asked.join(known, "path", "left").where(~F.coalesce("is_file", F.lit(False))).select(
        "path", F.when(F.col("is_file").isNull(), "not_found").otherwise("not_a_file").alias("status"), none.alias("position")
    )
    inside, behind = files.where(matches_extension(F.col("path"), extensions)), F.lit(0).cast("bigint")
    if folder is not None:
        root = folder.rstrip("/")
        below = F.col("path").startswith(root + "/")
        inside = inside.where(below)
        if max_depth is not None:
            rest = F.substring("path", len(root) + 2, 1 << 30)
            inside = inside.where(F.length(rest) - F.length(F.replace(rest, F.lit("/"), F.lit(""))) <= max_depth)
        at_root = F.col("path").isin(root, root + "/")
        state = known.agg(
            F.coalesce(F.bool_or(below | (at_root & ~F.col("is_file"))), F.lit(False)).alias("there"),
            F.coalesce(F.bool_or(at_root & F.col("is_file")), F.lit(False)).alias("file"),
        )
        missing = missing.union(
            state.where("file OR NOT there").select(
                F.lit(folder), F.when(F.col("file"), "not_a_folder").otherwise("folder_not_found"), none
            )
        )
    chosen = (
        asked.join(files, "path", "left_semi")
        .select("path", F.lit(0).alias("origin"), "place")
        .union(inside.select("path", F.lit(1).alias("origin"), behind.alias("place")))
        .groupBy("path")
        .agg(F.min(F.struct("origin", "place")).alias("first"))
        .select("path", "first.origin", "first.place")
    )
    numbered = row_numbers(chosen, [], ["origin", "place", "path"], "position")
    beyond = F.lit(False) if max_files is None else F.col("position") > max_files
    return numbered.select(
        "path",
        F.when(beyond, "over_limit").otherwise("registered").alias("status"),
        F.when(~beyond, F.col("position")).alias("position"),
    ).unionByName(missing)
