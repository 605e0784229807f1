"""JSON payloads cut to a size that fits a prompt: long text, long lists and wide maps."""

from __future__ import annotations

import json
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxtrace.functions.text import MAX_LIST, MAX_MAP, MAX_MESSAGE, MAX_TEXT, truncate

# The key of a directory tree, names of its counts, and what stands for left-out parts.
TREE_KEY = "tree_struct"
TREE_NOTE = "directory tree omitted from reduced payload"
NO_TREE_NOTE = "non-object directory tree omitted"
FOLDER_TYPES = ("directory", "symlink")
OMITTED_ITEMS, OMITTED_KEYS = "omitted_items", "omitted_keys"


def tree_counts(tree: Any) -> dict[str, Any]:
    """Name, path and numbers of files and folders of a directory tree, root included."""
    if not isinstance(tree, dict):
        return {"summary": NO_TREE_NOTE}
    seen = {"file": 0, "folder": 0}
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            kind = node.get("type")
            if kind == "file":
                seen["file"] += 1
            elif isinstance(kind, str) and kind in FOLDER_TYPES:
                seen["folder"] += 1
            below = node.get("children")
            waiting.extend(below if isinstance(below, list) else [])
    return {
        "summary": TREE_NOTE, "root_name": tree.get("name"), "root_path": tree.get("path"),
        "file_count": seen["file"], "directory_count": seen["folder"],
    }


def _cut(text: str) -> str:
    left_out = len(text) - MAX_TEXT
    return text if left_out <= 0 else f"{text[:MAX_TEXT]}... [truncated {left_out} chars]"


def reduced(value: Any) -> Any:
    """The value with every text, list and map in it, at any depth, cut to its limit.

    A list that is cut ends with the number of items left out, a map with the number of keys.
    Directory trees become counts wherever they stand among the kept keys.
    """
    match value:
        case str():
            return _cut(value)
        case list():
            tail = [{OMITTED_ITEMS: len(value) - MAX_LIST}] if len(value) > MAX_LIST else []
            return [reduced(v) for v in value[:MAX_LIST]] + tail
        case dict():
            small = {
                k: tree_counts(v) if k == TREE_KEY else reduced(v)
                for k, v in islice(value.items(), MAX_MAP)
            }
            rest = list(islice(value, MAX_MAP, None))
            if rest[:1] == [TREE_KEY]:  # its counts are small: just behind the limit they still fit
                small[TREE_KEY] = tree_counts(value[TREE_KEY])
                rest = rest[1:]
            if rest:
                small[OMITTED_KEYS] = len(value) - MAX_MAP
            return small
        case _:
            return value


@F.udf(StringType(), useArrow=False)  # rows of a hundred at a time; Arrow would hold ten thousand payloads
def _reduced_json(payload: str | None) -> str | None:
    if payload is None:
        return None
    try:
        return json.dumps(reduced(json.loads(payload)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return _cut(payload)


def reduce_payload(payload: Column) -> Column:
    """JSON text reduced at every depth; text that is no JSON is cut as a text, null stays null."""
    return _reduced_json(payload)


def reduce_messages(messages: DataFrame, content: str = "text", limit: int = MAX_MESSAGE) -> DataFrame:
    """Messages with their content cut to ``limit`` characters; other columns stay as they are."""
    return messages.withColumn(content, truncate(F.col(content), limit))
