"""Plans as text and as facts: what the optimizer made, what reaches the scans, what they read.

The only module besides ``sql`` that touches Spark's internal query execution.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def describe(df: DataFrame) -> str:
    """The analyzed and the optimized logical plan, as indented trees. Doesn't run the query."""
    execution = df._jdf.queryExecution()
    return f"== Logical plan ==\n{execution.analyzed().toString()}\n== Optimized plan ==\n{execution.optimizedPlan().toString()}"


def optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@dataclass
class Scan:
    location: str
    columns: list[str]
    pushed: list[str]
    metrics: dict[str, int] = field(default_factory=dict)


def _scans(plan) -> Iterator:
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        plan, name = plan.executedPlan(), plan.executedPlan().getClass().getSimpleName()
    if name == "FileSourceScanExec":
        yield plan
    if name.endswith("QueryStageExec"):
        yield from _scans(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from _scans(children.apply(i))


def scans(df: DataFrame) -> list[Scan]:
    """The file scans of a query's physical plan: columns read, filters pushed, and after an
    action on this very DataFrame what the scans did (numOutputRows, numFiles, filesSize)."""
    found = []
    for scan in _scans(df._jdf.queryExecution().executedPlan()):
        metadata = scan.metadata()
        pushed = metadata.get("PushedFilters")
        text = pushed.get() if pushed.isDefined() else "[]"
        location = metadata.get("Location")
        metrics = {}
        keys = scan.metrics().keys().toSeq()
        for i in range(keys.size()):
            key = keys.apply(i)
            metrics[key] = scan.metrics().apply(key).value()
        columns = [f for f in scan.requiredSchema().fieldNames()]
        found.append(Scan(location.get() if location.isDefined() else "", columns, re.findall(r"\w+\([^()]*(?:\([^()]*\)[^()]*)*\)", text), metrics))
    return found


@contextmanager
def optimizer_trace(spark: SparkSession, level: str = "WARN") -> Iterator[None]:
    """Within the block every rule that changes a plan logs how, at the given level."""
    with _setting(spark, "spark.sql.planChangeLog.level", level):
        yield


@contextmanager
def without_rules(spark: SparkSession, *rules: str) -> Iterator[None]:
    """Within the block the optimizer leaves out rules (class names below its package), to compare
    results with and without them."""
    prefix = "org.apache.spark.sql.catalyst.optimizer."
    with _setting(spark, "spark.sql.optimizer.excludedRules", ",".join(prefix + r for r in rules)):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
