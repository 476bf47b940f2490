"""The SQL front door: queries only, checked before anything runs.

Spark would carry out a command as soon as it is given to ``spark.sql``. So the text is first
parsed alone, and only plans whose root is a query go on (a list of what is allowed, not of what
is refused). ``strict`` also refuses the query forms beyond the engine's core dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.errors import ParseError, PlanError, translated
from tarnlake.sources.catalog import Catalog

QUERY_NODES = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedWith", "WithCTE", "Distinct", "Union", "Intersect", "Except", "UnresolvedHaving", "WithWindowDefinition", "Generate",
    "Pivot", "Unpivot", "UnresolvedHint", "RepartitionByExpression", "Repartition", "Sample", "UnresolvedTableValuedFunction", "Expand", "Window",
}
#: Plan nodes and expressions of the core dialect (strict).
CORE_NODES = {"Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "SubqueryAlias", "UnresolvedRelation"}
BEYOND_EXPRESSIONS = {
    "WindowExpression", "UnresolvedWindowExpression", "ScalarSubquery", "Exists", "ListQuery", "InSubquery", "CaseWhen", "Cast", "In", "Like", "RLike", "Between", "IsNull", "IsNotNull", "Not", "UnaryMinus", "Remainder",
    "Concat", "BitwiseAnd", "BitwiseOr", "BitwiseXor", "IntegralDivide",
}
CORE_FUNCTIONS = {"sum", "count", "avg", "min", "max"}


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _walk(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _walk(children.apply(i))


def parse(spark: SparkSession, sql: str):
    """Spark's unresolved plan of a query's text. Nothing is run or resolved."""
    if not sql.strip():
        raise ParseError("empty SQL")
    with translated():
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if _name(plan) not in QUERY_NODES:
        raise ParseError(f"Only SELECT queries are supported, not {_name(plan)}")
    return plan


def check_core(plan) -> None:
    """Refuse what lies outside the core dialect: one SELECT over joined tables with the five
    aggregates, no DISTINCT, HAVING, OFFSET, set operations, CTEs, subqueries or windows."""
    for node in _walk(plan):
        name = _name(node)
        if name not in CORE_NODES:
            raise PlanError(f"strict: {name} is outside the core dialect")
        if name == "Join" and node.joinType().sql() not in ("INNER", "LEFT OUTER"):
            raise PlanError(f"strict: {node.joinType().sql()} JOIN is outside the core dialect")
        expressions = node.expressions()
        for i in range(expressions.size()):
            for e in _walk(expressions.apply(i)):
                kind = _name(e)
                if kind == "Not" and _name(e.children().apply(0)) == "EqualTo":
                    continue  # how <> is parsed
                if kind in BEYOND_EXPRESSIONS:
                    raise PlanError(f"strict: {kind} is outside the core dialect")
                if kind == "UnresolvedFunction":
                    called = e.nameParts().mkString(".").lower()
                    if called.rpartition(".")[2] not in CORE_FUNCTIONS:
                        raise PlanError(f"strict: function {called} is outside the core dialect")
                    if e.isDistinct() or e.filter().isDefined():
                        raise PlanError("strict: DISTINCT and FILTER in aggregates are outside the core dialect")


def _outputs(plan) -> list | None:
    """The expressions of the outermost select list; None if a star stands in it, or there is none."""
    while _name(plan) in ("Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "UnresolvedHaving"):
        plan = plan.children().apply(0)
    if _name(plan) not in ("Project", "Aggregate"):
        return None
    listed = plan.projectList() if _name(plan) == "Project" else plan.aggregateExpressions()
    out = [listed.apply(i) for i in range(listed.size())]
    return None if any("Star" in _name(e) for e in out) else out


def _named(df: DataFrame, plan) -> DataFrame:
    """The result with default names for the outputs that have none."""
    outputs = _outputs(plan)
    if outputs is None or len(outputs) != len(df.columns):
        return df
    names = list(df.columns)
    for i, e in enumerate(outputs):
        if _name(e) == "UnresolvedAlias":
            child = e.children().apply(0)
            called = child.nameParts().mkString(".").lower() if _name(child) == "UnresolvedFunction" else ""
            names[i] = called if called in CORE_FUNCTIONS else "expr"
    return df if names == df.columns else df.toDF(*names)


def run_sql(spark: SparkSession, sql: str, folder: str | Catalog | None = None, strict: bool = False) -> DataFrame:
    """A query over the tables of a folder (None: over the session's views), as a DataFrame.

    One trailing semicolon is fine. An output without a name of its own is called after its
    aggregate (sum, count, avg, min, max), any other expression expr. Rows with NULL keys don't join, NULL arguments don't count,
    AND and OR are three-valued, a global aggregate of no rows is one row: ANSI throughout."""
    sql = sql.strip().removesuffix(";")
    plan = parse(spark, sql)
    if strict:
        check_core(plan)
    if folder is not None:
        (folder if isinstance(folder, Catalog) else Catalog(spark, folder)).register()
    with translated():
        return _named(spark.sql(sql), plan)
