"""Expressions: columns, literals, the twelve binary operators and the five aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.errors import PlanError

BINARY = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
}
AGGREGATES = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}


def expression(e: str | Column) -> Column:
    """SQL text or a column, as a column."""
    return F.expr(e) if isinstance(e, str) and e != "*" else F.col(e) if isinstance(e, str) else e


def binary(left: str | Column, op: str, right: str | Column) -> Column:
    """One of the twelve operators; AND and OR are three-valued, / is fractional."""
    if op.lower() not in BINARY:
        raise PlanError(f"unknown operator {op}")
    return BINARY[op.lower()](expression(left), expression(right))


def truncating_div(left: str, right: str) -> Column:
    """Integer division toward zero."""
    return F.expr(f"({left}) div ({right})")


def default_name(text: str) -> str:
    """The name of an unnamed output: the column's, the aggregate's, or expr."""
    text = text.strip()
    if re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", text):
        return text.rpartition(".")[2]
    called = re.fullmatch(r"(\w+)\s*\(.*\)", text, re.S)
    return called[1].lower() if called and called[1].lower() in AGGREGATES else "expr"


@dataclass
class Aggregate:
    """sum, count, avg, min or max of an expression; count also of "*"."""

    function: str
    argument: str | Column = "*"
    name: str | None = None
    is_distinct: bool = False

    def column(self) -> Column:
        function = self.function.lower()
        if function not in AGGREGATES:
            raise PlanError(f"unknown aggregate {self.function}")
        star = isinstance(self.argument, str) and self.argument == "*"
        if star and function != "count":
            raise PlanError(f"{function}(*) isn't an aggregate")
        argument = F.lit(1) if star else expression(self.argument)
        if self.is_distinct:
            out = F.count_distinct(argument) if function == "count" else F.sum_distinct(argument) if function == "sum" else AGGREGATES[function](argument)
        else:
            out = AGGREGATES[function](argument)
        return out.alias(self.name or function)


def evaluate(df: DataFrame, e: str | Column) -> DataFrame:
    """One column, ``value``: the expression over every row of df."""
    return df.select(expression(e).alias("value"))
