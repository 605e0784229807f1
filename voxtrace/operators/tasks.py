"""Task specifications: validation, variant expansion, filtering and answer checks."""

from __future__ import annotations

import ast
import contextlib
import json
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.functions.predicates import is_dict, is_string
from voxtrace.operators.ordered import salted_lookup
from voxtrace.sources.json_docs import json_status

# The five evaluation keys of a task.
EVALUATION_KEYS = [
    "dimension_A_routing",
    "dimension_B_task",
    "dimension_C_tools",
    "dimension_D_artifacts",
    "dimension_E_final_output",
]


def validate_tasks(tasks: DataFrame, index: str, text: str) -> DataFrame:
    """(index, task_id, error): the first broken rule of every task, null if none."""
    def part(path: str) -> Column:
        return F.try_variant_get("_v", path, "variant")

    known = F.array(*[F.lit(k) for k in EVALUATION_KEYS])
    read = (
        tasks.select(index, F.col(text).alias("_text"), json_status(F.col(text)).alias("_status"))
        .withColumn("_v", F.when(F.col("_status") == "ok", F.try_parse_json("_text")))
        .withColumn(
            "task_id",
            F.when(
                is_string(part("$.id")), F.try_variant_get("_v", "$.id", "string")
            ),
        )
        .withColumn(
            "_keys", F.json_object_keys(F.get_json_object("_text", "$.evaluation"))
        )
        .withColumn("_evaluation", is_dict(part("$.evaluation")))
    )
    usable = F.col("task_id").isNotNull() & (F.col("task_id") != "")
    first = read.where(usable).groupBy("task_id").agg(F.min(index).alias("_first"))
    unknown = F.sort_array(F.array_except("_keys", known))
    missing = F.sort_array(F.array_except(known, "_keys"))
    not_object = F.coalesce(
        *[F.when(~is_dict(part(f"$.evaluation.{k}")), F.lit(k)) for k in sorted(EVALUATION_KEYS)]
    )
    checked = salted_lookup(read, first, ["task_id"], [index], "left")
    return checked.select(
        index,
        "task_id",
        F.when(F.col("_status") != "ok", "must be a JSON object")
        .when(~F.coalesce(usable, F.lit(False)), "must contain a non-empty string id")
        .when(F.col("_first") < F.col(index), "duplicate task id")
        .when(~F.col("_evaluation"), "must contain an evaluation object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ",")))
        .when(not_object.isNotNull(), F.concat(F.lit("not an object: "), not_object))
        .alias("error"),
    )


def expand_field(
    tasks: DataFrame,
    field: str,
    slugger: Callable[[Column], Column],
    parallel: str | None = None,
) -> DataFrame:
    """One task per distinct trimmed value of a list field.

    The id is suffixed only where there is more than one value. A parallel list of the same
    length is zipped by the first place of the value. A blank value raises an error.
    """
    trimmed = F.transform(field, lambda v: F.trim(v))
    checked = F.when(
        F.exists(trimmed, lambda v: F.coalesce(v == "", F.lit(True))) | (F.size(trimmed) == 0),
        F.raise_error(F.concat(F.lit(f"{field} list must contain only non-empty strings: "), "task_id")),
    ).otherwise(trimmed)
    values = tasks.withColumn("_all", checked).withColumn("_values", F.array_distinct("_all"))
    one = values.withColumn("_one", F.explode("_values"))
    if parallel is not None:
        place = F.array_position("_all", F.col("_one")).cast("int") - 1
        zipped = F.size(parallel) == F.size("_all")
        one = one.withColumn(parallel, F.array(F.when(zipped, F.trim(F.get(parallel, place)))))
    return (
        one.withColumn(
            "task_id",
            F.when(
                F.size("_values") > 1, F.concat_ws("_", "task_id", slugger(F.col("_one")))
            ).otherwise(F.col("task_id")),
        )
        .withColumn(field, F.array("_one"))
        .drop("_all", "_values", "_one")
    )


def filter_tasks(
    tasks: DataFrame, allowed: DataFrame, id_column: str, source_column: str
) -> tuple[DataFrame, DataFrame]:
    """Tasks whose id or source id is allowed, and the allowed ids that match neither.

    ``allowed`` has one column ``wanted``.
    """
    wanted = allowed.select("wanted").distinct()
    by_id = tasks.join(wanted, F.col(id_column) == F.col("wanted"), "left").withColumnRenamed(
        "wanted", "_id"
    )
    both = by_id.join(wanted, F.col(source_column) == F.col("wanted"), "left")
    kept = both.where(F.col("_id").isNotNull() | F.col("wanted").isNotNull()).drop("_id", "wanted")
    known = tasks.select(F.col(id_column).alias("wanted")).union(tasks.select(source_column))
    return kept, wanted.join(known, "wanted", "left_anti")


_SIGNS = re.compile(r"[][{}'\"\\\\]")


def bracket_spans(text: str, quotes: str) -> list[tuple[int, int]]:
    """Balanced bracket pairs of ``text``, in order of their beginning, in one pass.

    Brackets between quotes don't count. Outside of brackets a quote is prose, and so is one that
    never ends: the scan goes on behind it, at most once for each kind of quote.
    """
    spans: list[tuple[int, int]] = []
    waiting: list[tuple[str, int]] = []
    at, prose = 0, set()
    quote, quote_end = "", 0
    while True:
        sign = _SIGNS.search(text, at)
        if sign is None:
            if not quote:
                return sorted(spans)
            prose.add(quote)
            quote, at = "", quote_end
            continue
        c, at = sign[0], sign.end()
        if c == "\\":
            at += bool(quote)
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            if waiting and c in quotes and c not in prose:
                quote, quote_end = c, at
        elif c in "[{":
            waiting.append((c, sign.start()))
        elif waiting and waiting[-1][0] == ("[" if c == "]" else "{"):
            spans.append((waiting.pop()[1], at))


def _plain_value(text: str) -> tuple[object, ...]:
    """The value of JSON text or of a Python literal of the same types, in a tuple; else none."""
    with contextlib.suppress(ValueError, RecursionError):
        return (json.loads(text),)
    with contextlib.suppress(ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        value = ast.literal_eval(text)
        if value is None or isinstance(value, dict | list | int | float):
            return (value,)
    return ()


def find_answer(text: str) -> tuple[object, ...]:
    """The value of a whole text, else of the first object in it, else of the first list."""
    whole = _plain_value(text)
    if whole:
        return whole
    first: tuple[object, ...] = ()
    for quotes in ("'\"", '"'):  # apostrophes may be prose within brackets, too
        for lo, hi in bracket_spans(text, quotes):
            value = _plain_value(text[lo:hi])
            if value and isinstance(value[0], dict):
                return value
            first = first or value
    return first


def _free_text_answers(texts: pd.Series) -> pd.DataFrame:
    kinds = {dict: "dict", list: "list", bool: "bool", int: "number", float: "number", str: "text", type(None): "null"}

    def answer(text: str | None) -> tuple[str, str | None]:
        found = find_answer(text.strip()) if text else ()
        return (kinds[type(found[0])], json.dumps(found[0], default=str)) if found else ("text", None)

    return pd.DataFrame([answer(t) for t in texts], columns=["kind", "json"])


def parse_answer(text: Column) -> Column:
    """Struct (kind, json) of a free-text answer.

    Texts that are JSON as a whole are read by Spark; only the others reach Python, where the
    first balanced object counts, else the first other balanced value, else it stays text.
    """
    variant = F.try_parse_json(text)
    shape = F.schema_of_variant(variant)
    kind = (
        F.when(shape.startswith("OBJECT"), "dict")
        .when(shape.startswith("ARRAY"), "list")
        .when(shape == "BOOLEAN", "bool")
        .when(shape == "STRING", "text")
        .when(shape == "VOID", "null")
        .otherwise("number")
    )
    read = F.pandas_udf(_free_text_answers, "struct<kind string, json string>")
    rest = read(F.when(variant.isNull(), text))
    return (
        F.when(text.isNull(), F.struct(F.lit("null").alias("kind"), F.lit(None).cast("string").alias("json")))
        .when(variant.isNotNull(), F.struct(kind.alias("kind"), F.to_json(variant).alias("json")))
        .otherwise(rest)
    )


def evaluate_rules(answers: DataFrame, keys: Sequence[str], rules: Mapping[str, str]) -> DataFrame:
    """One row per (keys, rule): rules are SQL boolean text over the columns of ``answers``.

    A rule that cannot be analysed, or has no truth value, fails. Rules should use the
    ``try_`` functions where a value may be out of range.
    """
    checks = []
    for name, rule in rules.items():
        try:
            answers.select(F.expr(rule).cast("boolean"))
            passed = F.coalesce(F.expr(rule).cast("boolean"), F.lit(False))
        except (AnalysisException, ParseException):
            passed = F.lit(False)
        checks.append(F.struct(F.lit(name).alias("rule"), passed.alias("passed")))
    return answers.select(*keys, F.inline(F.array(*checks)))


def final_answer_points(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rules of an answer must hold."""
    return checked.groupBy(*keys).agg(
        F.count("*").alias("rules"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.bool_and("passed").alias("correct"),
    )
