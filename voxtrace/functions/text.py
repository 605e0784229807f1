"""Text rules: sample ids, slugs, template rendering, truncation, selectors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and markers that are not part of a sample id.
IMAGE_SUFFIXES = r"(?i)(\.nii\.gz|\.nii|\.tiff|\.tif)$"
ROLE_SUFFIXES = ("_original", "_mask", "_components")
ROLE_MARKERS = ("_segmented_", "_lacunae_components", "_crack_components", "_component_components")


def sample_id(path: Column) -> Column:
    """Sample id of an artifact path: no folders, suffixes, role suffixes or role markers."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.when(name.rlike(IMAGE_SUFFIXES), F.regexp_replace(name, IMAGE_SUFFIXES, "")).otherwise(
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    )
    for suffix in ROLE_SUFFIXES:
        stem = F.regexp_replace(stem, f"{suffix}$", "")
    for marker in ROLE_MARKERS:
        stem = F.regexp_replace(stem, f"{marker}.*$", "")
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*/*$", 1)
    return F.when(stem != "", stem).otherwise(parent)


def slug(value: Column, empty: str = "patient") -> Column:
    """Runs of other characters become one underscore; edges are trimmed."""
    cleaned = F.regexp_replace(F.trim(value), r"[^A-Za-z0-9_.-]+", "_")
    cleaned = F.regexp_replace(cleaned, r"^[._-]+|[._-]+$", "")
    return F.when(cleaned == "", F.lit(empty)).otherwise(cleaned)


def path_slug(value: Column) -> Column:
    """Slug of the file stem; ``_original`` is dropped."""
    name = F.regexp_extract(F.trim(value), r"([^/]*)/*$", 1)
    stem = F.when(name.endswith(".nii.gz"), F.regexp_replace(name, r"\.nii\.gz$", "")).otherwise(
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    )
    return slug(F.regexp_replace(stem, "_original$", ""))


def dataset_slug(value: Column) -> Column:
    """Slug of the last folder; numbered groups keep their parent's name."""
    trimmed = F.regexp_replace(F.trim(value), "/+$", "")
    name = F.regexp_extract(trimmed, r"([^/]*)$", 1)
    parent = F.regexp_extract(trimmed, r"([^/]+)/[^/]*$", 1)
    # Folder names that do not identify a dataset on their own.
    grouped = name.isin("group_1", "group_2") & (parent != "")
    return F.when(grouped, slug(F.concat_ws("_", parent, name))).otherwise(slug(name))


def render(template: Column, fields: Sequence[str]) -> Column:
    """Replace ``{field}`` by the row's own fields, also within their values; unknown ones stay.

    One round replaces all fields at once, so a value that looks like a field is only replaced
    in the next round. A chain of fields that name each other is no longer than the fields are
    many, so as many rounds reach its end; fields that name each other in a circle stay.
    """
    text = template
    for _ in range(len(fields) + 1):
        text = _render_once(text, fields)
    return text


def _render_once(text: Column, fields: Sequence[str]) -> Column:
    # Split at every known field; odd places of the result are field names.
    names = "|".join(re.escape(f) for f in fields)
    mark = "\u0001"
    marked = F.regexp_replace(text, "\\{(" + names + ")\\}", f"{mark}$1{mark}")
    values = F.create_map(
        *[x for f in fields for x in (F.lit(f), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("None")))]
    )
    parts = F.split(marked, mark)
    return F.array_join(
        F.transform(
            parts, lambda part, i: F.when(i % 2 == 1, F.try_element_at(values, part)).otherwise(part)
        ),
        "",
    )


# Limits of the reduced payload.
MAX_TEXT, MAX_MESSAGE, MAX_LIST, MAX_MAP = 1800, 2400, 24, 80


def truncate(text: Column, limit: int = MAX_TEXT) -> Column:
    """Cut long text and say how much was left out."""
    return F.when(
        F.length(text) > limit,
        F.concat(
            F.substring(text, 1, limit),
            F.lit("... [truncated "),
            (F.length(text) - limit).cast("string"),
            F.lit(" chars]"),
        ),
    ).otherwise(text)


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern."""
    out, i = "", 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2)
        if char == "*":
            out += ".*"
        elif char == "?":
            out += "."
        elif char == "[" and close > 0:
            inner = pattern[i + 1 : close]
            negated = inner.startswith("!")
            inner = re.sub(r"([\\\[&^])", r"\\\1", inner[1:] if negated else inner)
            out += ("[^" if negated else "[") + inner + "]"
            i = close
        else:
            out += re.escape(char)
        i += 1
    return f"(?s)^{out}$"


def matches_pattern(value: Column, patterns: Sequence[str]) -> Column:
    """Any pattern matches: shell patterns by glob, plain text by containment."""
    found = F.lit(False)
    for p in patterns:
        glob = any(c in p for c in "*?[")
        found = found | (value.rlike(glob_to_regex(p)) if glob else value.contains(p))
    return found


def reduce_list(items: Column, limit: int = MAX_LIST) -> Column:
    """Struct (items, omitted): at most ``limit`` items and the number left out."""
    return F.struct(
        F.slice(items, 1, limit).alias("items"),
        F.greatest(F.size(items) - limit, F.lit(0)).cast("bigint").alias("omitted"),
    )


def reduce_map(entries: Column, limit: int = MAX_MAP) -> Column:
    """Struct (entries, omitted): at most ``limit`` keys and the number left out."""
    return F.struct(
        F.map_from_entries(F.slice(F.map_entries(entries), 1, limit)).alias("entries"),
        F.greatest(F.size(entries) - limit, F.lit(0)).cast("bigint").alias("omitted"),
    )
