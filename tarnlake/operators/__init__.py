"""The relational operators as functions over DataFrames. Each only declares; Catalyst plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from tarnlake.errors import PlanError
from tarnlake.functions import Aggregate, default_name, expression

#: Rows of a table that ``deal`` gives to a task, more or less.
TASK_ROWS = 250_000


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, predicate: str | Column | None = None, alias: str | None = None) -> DataFrame:
    """A Parquet table. Columns and predicate reach the reader by column pruning and pushdown."""
    df = spark.read.parquet(path)
    if alias is not None:
        df = df.alias(alias)
    if predicate is not None:
        df = df.where(expression(predicate))
    return df if columns is None else df.select(*columns)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows, with a schema."""
    return spark.createDataFrame([], schema)


def project(df: DataFrame, *exprs: str | Column | tuple[str | Column, str]) -> DataFrame:
    """Expressions, or (expression, name). Unnamed ones are called as ``default_name`` says."""
    out = []
    for e in exprs:
        if isinstance(e, tuple):
            out.append(expression(e[0]).alias(e[1]))
        elif isinstance(e, str) and not e.endswith("*") and " as " not in e.lower():
            out.append(expression(e).alias(default_name(e)))
        else:
            out.append(expression(e))
    return df.select(*out)


def filter_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows for which the predicate is true (three-valued: null isn't)."""
    return df.where(expression(predicate))


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str | Column, str | Column]], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on pairs of key expressions, each over either side. NULL keys match nothing
    unless null_safe. Spark picks broadcast, sort-merge or hash, and splits skewed keys."""
    if not on:
        raise PlanError("a join needs at least one pair of keys")
    condition = None
    for a, b in on:
        one = expression(a).eqNullSafe(expression(b)) if null_safe else expression(a) == expression(b)
        condition = one if condition is None else condition & one
    return left.join(right, condition, how)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """A table for joins and groups by the same keys, where one task holds the sorts of both sides
    and the groups at a time: dealt by the keys over so many tasks that each gets about TASK_ROWS,
    whatever the session's number of partitions, and not broadcast (Spark goes by the size of the
    files, which says little of that in memory). Rows are counted from the footers."""
    rows = df.count()
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys).hint("merge")


def aggregate(df: DataFrame, keys: Sequence[str | Column | tuple[str | Column, str]], aggregates: Sequence[Aggregate]) -> DataFrame:
    """Grouped by keys, or global without any (then one row, even of no rows). NULL arguments
    are skipped, NULL keys are a group."""
    if not aggregates:
        raise PlanError("an aggregation needs at least one aggregate")
    named = [expression(k[0]).alias(k[1]) if isinstance(k, tuple) else expression(k) for k in keys]
    out = [a.column() for a in aggregates]
    return df.groupBy(*named).agg(*out) if named else df.agg(*out)


def sort(df: DataFrame, *keys: str | tuple[str, str]) -> DataFrame:
    """By expressions, or (expression, "asc" or "desc"); NULLs last in either direction."""
    order = []
    for key in keys:
        name, way = (key, "asc") if isinstance(key, str) else key
        order.append(expression(name).desc_nulls_last() if way.lower() == "desc" else expression(name).asc_nulls_last())
    return df.orderBy(*order)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n rows at most. Over a sort this is one TakeOrderedAndProject, not a full sort."""
    if not isinstance(n, int) or n < 0 or offset < 0:
        raise PlanError("LIMIT and OFFSET take integers from 0")
    return (df.offset(offset) if offset else df).limit(n)


def top_k(df: DataFrame, n: int, *keys: str | tuple[str, str]) -> DataFrame:
    return limit(sort(df, *keys), n)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


__all__ = ["aggregate", "deal", "distinct", "empty", "filter_rows", "join", "limit", "project", "scan", "sort", "top_k", "union_all"]
