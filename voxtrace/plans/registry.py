"""All queries and their SQL counterparts, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxtrace.plans import (
    audit_plans,
    component_plans,
    run_plans,
    segmentation_plans,
    similarity_plans,
    source_plans,
    task_plans,
    trace_plans,
    volume_plans,
)

MODULES = [
    audit_plans,
    source_plans,
    volume_plans,
    component_plans,
    segmentation_plans,
    similarity_plans,
    trace_plans,
    task_plans,
    run_plans,
]

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    merged: dict[str, Query] = {}
    for module in MODULES:
        merged.update(module.QUERIES)
    return merged


def all_oracles() -> dict[str, str]:
    merged: dict[str, str] = {}
    for module in MODULES:
        merged.update(module.ORACLES)
    return merged
