"""The relational queries that are registered with the driver, and their SQL for DuckDB.

A query is (tables, Spark SQL, DuckDB SQL or None if the same text does). Doubles that are summed
are rounded, because the order of a sum is free; every column has a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import operators as op
from tarnlake.functions import Aggregate, binary, truncating_div
from tarnlake.plans import run_sql
from tarnlake.sources import Catalog

REVENUE = "l_extendedprice * (1 - l_discount)"

SQL: dict[str, tuple[str, str, str | None]] = {
    "scan_star": ("nation", "SELECT * FROM nation", None),
    "scan_project_alias": ("lineitem", "SELECT l_orderkey AS okey, l_quantity AS qty, l_shipdate AS shipped FROM lineitem", None),
    "filter_eq": ("orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_neq": ("orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey != 1", None),
    "filter_lt": ("lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 10", None),
    "filter_le": ("lineitem", "SELECT l_orderkey, l_discount + 0.0 AS discount FROM lineitem WHERE l_discount <= 0.02", "SELECT l_orderkey, l_discount + CAST(0 AS DOUBLE) AS discount FROM lineitem WHERE l_discount <= 0.02"),
    "filter_gt": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE 100000 < o_totalprice", None),
    "filter_ge": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000.5", None),
    "filter_string": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '2' AND o_orderpriority <= '4-NOT'", None),
    "filter_timestamp": ("lineitem", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1998-02-01 00:00:00'", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-02-01 00:00:00'"),
    "filter_int32": ("part", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 12", None),
    "filter_and_or_nested": ("lineitem", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE (l_quantity < 5 OR l_quantity > 45) AND (l_returnflag = 'R' OR (l_linestatus = 'F' AND l_tax > 0.05))", None),
    "filter_three_valued": ("documents labels", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 OR d.n_chars > 500", None),
    "filter_col_vs_col": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax", None),
    "filter_arithmetic": ("lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity * 2 - 1 > 95", None),
    "project_arith": ("lineitem", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS unit, l_quantity + 1 AS more, l_quantity - 1 AS less FROM lineitem", None),
    "project_int_div": ("lineitem", "SELECT l_orderkey, l_partkey div 7 AS part_div, (0 - l_linenumber) div 2 AS negative_div FROM lineitem", "SELECT l_orderkey, l_partkey // 7 AS part_div, (0 - l_linenumber) // 2 AS negative_div FROM lineitem"),
    "project_bool_expr": ("orders", "SELECT o_orderkey, o_totalprice > 100000 AS big, o_orderstatus = 'F' AND o_totalprice > 100000 AS big_f FROM orders", None),
    "project_literals": ("region", "SELECT r_regionkey, 7 AS i, 'x' AS s, TRUE AS b, r_name FROM region", None),
    "const_true_filter": ("region", "SELECT r_regionkey, r_name FROM region WHERE 1 = 1", None),
    "const_false_filter": ("region", "SELECT r_regionkey, r_name FROM region WHERE 1 = 2", None),
    "agg_global": ("lineitem", "SELECT SUM(l_linenumber) AS s, COUNT(*) AS c, ROUND(AVG(l_quantity), 6) AS a, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, COUNT(*) AS c, ROUND(AVG(l_quantity), 6) AS a, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem"),
    "agg_count_star_only": ("lineitem", "SELECT COUNT(*) AS c FROM lineitem", None),
    "agg_global_empty_input": ("lineitem", "SELECT COUNT(*) AS c, SUM(l_quantity) AS s, MIN(l_shipmode) AS m FROM (SELECT l_quantity, l_returnflag AS l_shipmode FROM lineitem WHERE l_quantity < 0) x", None),
    "agg_group_empty_input": ("lineitem", "SELECT l_returnflag, COUNT(*) AS c FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag", None),
    "agg_global_minmax_string": ("nation", "SELECT MIN(n_name) AS lo, MAX(n_name) AS hi FROM nation", None),
    "agg_minmax_timestamp": ("orders", "SELECT o_orderstatus, MIN(o_orderdate) AS first_date, MAX(o_orderdate) AS last_date FROM orders GROUP BY o_orderstatus", None),
    "agg_group_one_key": ("orders", "SELECT o_orderstatus, COUNT(*) AS c, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus", None),
    "agg_group_multi_key": ("lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c, MAX(l_tax) AS tax FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_group_int32_key": ("nation", "SELECT n_regionkey, COUNT(*) AS c FROM nation GROUP BY n_regionkey", None),
    "agg_group_timestamp_key": ("orders", "SELECT o_orderdate, COUNT(*) AS c FROM orders GROUP BY o_orderdate", None),
    "agg_group_string_key": ("events", "SELECT event_type, COUNT(*) AS c, ROUND(SUM(value), 4) AS v FROM events GROUP BY event_type", None),
    "agg_group_expr_key": ("lineitem", "SELECT l_linenumber + 1 AS line, COUNT(*) AS c FROM lineitem GROUP BY l_linenumber + 1", None),
    "agg_over_expr": ("lineitem", f"SELECT l_returnflag, ROUND(SUM({REVENUE}), 2) AS revenue FROM lineitem GROUP BY l_returnflag", None),
    "agg_expr_over_aggs": ("lineitem", "SELECT l_returnflag, ROUND(SUM(l_quantity) / COUNT(*), 6) AS mean FROM lineitem GROUP BY l_returnflag", None),
    "agg_null_arg": ("documents labels", "SELECT d.lang, COUNT(*) AS n, COUNT(l.quality) AS labelled, SUM(l.quality) AS good, MIN(l.quality) AS lo, MAX(l.toxic) AS hi, ROUND(AVG(l.quality), 6) AS mean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang", "SELECT d.lang, COUNT(*) AS n, COUNT(l.quality) AS labelled, CAST(SUM(l.quality) AS BIGINT) AS good, MIN(l.quality) AS lo, MAX(l.toxic) AS hi, ROUND(AVG(l.quality), 6) AS mean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang"),
    "agg_null_key": ("documents labels", "SELECT l.quality, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", None),
    "join_inner": ("customer orders", "SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "join_reversed_on": ("customer orders", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000", None),
    "join_multi_key": ("lineitem", "SELECT a.l_orderkey, a.l_linenumber, COUNT(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber", None),
    "join_expr_key": ("nation region", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey + 1 = r.r_regionkey + 1", None),
    "join_literal_key": ("nation region", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey = 1", None),
    "join_self": ("nation", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None),
    "join_chain_5": ("region nation customer orders lineitem", f"SELECT r.r_name, COUNT(*) AS c, ROUND(SUM({REVENUE}), 2) AS revenue FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY r.r_name", None),
    "join_filter_both_sides": ("customer orders", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 5000 AND o.o_orderstatus = 'O' AND c.c_acctbal < o.o_totalprice", None),
    "join_qualified_star": ("nation region", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_left": ("documents labels", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "join_null_keys": ("documents labels", "SELECT a.quality, COUNT(*) AS n FROM (SELECT NULLIF(quality, 0) AS quality FROM labels) a JOIN (SELECT DISTINCT NULLIF(toxic, 1) + 1 AS quality FROM labels) b ON a.quality = b.quality GROUP BY a.quality", None),
    "sort_multi_asc_desc": ("orders", "SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders ORDER BY o_orderstatus ASC, o_orderpriority DESC, o_orderkey", None),
    "sort_nulls_last": ("documents labels", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id", None),
    "sort_nulls_first": ("documents labels", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS FIRST, d.doc_id", None),
    "limit_topk": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 10", None),
    "limit_zero": ("orders", "SELECT o_orderkey FROM orders LIMIT 0", None),
    "sort_by_alias_of_agg": ("orders", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC NULLS LAST, o_custkey", None),
    "join_group_sort_limit": ("nation customer orders", "SELECT n.n_name, ROUND(SUM(o.o_totalprice), 2) AS total FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY n.n_name ORDER BY total DESC NULLS LAST LIMIT 5", None),
    "tpch_q6_shape": ("lineitem", "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24", "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24"),
    "tpch_q1_shape": ("lineitem", f"SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price, ROUND(SUM({REVENUE}), 2) AS sum_disc_price, ROUND(SUM({REVENUE} * (1 + l_tax)), 2) AS sum_charge, ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '2001-08-01 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", None),
    "having": ("orders", "SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "select_distinct": ("part", "SELECT DISTINCT p_brand, p_size FROM part", None),
    "count_distinct": ("orders", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus", None),
    "agg_filter": ("lineitem", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS many FROM lineitem GROUP BY l_returnflag", None),
    "offset": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", None),
    "union_all": ("customer supplier", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier", None),
    "cte": ("orders", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000) SELECT o_orderstatus, COUNT(*) AS c FROM big GROUP BY o_orderstatus", None),
    "semi_join": ("customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "union_distinct": ("customer supplier", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("customer supplier", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier", None),
    "except": ("nation customer", "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900", None),
    "join_right": ("customer orders", "SELECT c.c_custkey, c.c_name, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey", None),
    "join_full": ("documents labels", "SELECT d.doc_id, l.doc_id AS labelled, l.toxic FROM (SELECT * FROM documents WHERE n_chars > 400) d FULL JOIN labels l ON d.doc_id = l.doc_id", None),
    "anti_join": ("customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "case_when": ("orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS class FROM orders", None),
    "in_list": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (2, 5) AND l_returnflag NOT IN ('N', 'A')", None),
    "in_subquery": ("nation region", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B')", None),
    "between": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_orderkey NOT BETWEEN 10 AND 90", None),
    "cast": ("part", "SELECT p_partkey, CAST(p_size AS BIGINT) AS wide, CAST(p_partkey AS DOUBLE) AS real_key, CAST(p_size AS VARCHAR(20)) AS text_size FROM part", None),
    "is_null": ("documents labels", "SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL OR d.lang = 'en'", None),
    "like": ("part", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%1%' AND p_brand NOT LIKE '%2'", None),
    "scalar_subquery": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) AND o_orderstatus = 'F'", None),
    "window_sum": ("orders", "SELECT o_orderkey, o_custkey, COUNT(*) OVER (PARTITION BY o_custkey) AS placed, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders", None),
    "window_rank": ("orders", "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders", None),
}


#: Queries that group by the keys of their join: their table and the keys it is dealt by.
DEALT = {"join_multi_key": ("lineitem", "l_orderkey", "l_linenumber")}


def _sql_query(tables: str, sql: str, dealt: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog(spark, sf_dir).register(*tables.split())
        if not dealt:
            return run_sql(spark, sql)
        name, *keys = dealt
        op.deal(catalog.table(name), *keys).createOrReplaceTempView(name)
        try:
            return run_sql(spark, sql)
        finally:
            catalog.register(name)

    return run


def df_scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.scan(spark, f"{sf_dir}/lineitem.parquet", predicate=binary("l_quantity", ">=", F.lit(49.0)) & binary("l_tax", "<", "l_discount"))
    return op.project(rows, "l_orderkey", ("l_extendedprice * 2", "double_price"), (truncating_div("l_partkey", "10"), "bin"))


def df_join_aggregate_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Catalog(spark, sf_dir)
    joined = op.join(tables.table("customer").alias("c"), tables.table("orders").alias("o"), [("o.o_custkey", "c.c_custkey")])
    totals = op.aggregate(joined, ["c_mktsegment"], [Aggregate("count", name="orders"), Aggregate("max", "o_totalprice", "largest"), Aggregate("count", "o_custkey", "customers", is_distinct=True)])
    return op.top_k(totals, 3, ("orders", "desc"), "c_mktsegment")


def df_join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = Catalog(spark, sf_dir).table("labels").selectExpr("doc_id", "NULLIF(quality, 0) AS q")
    kinds = op.distinct(labels, "q")
    pairs = op.join(labels.alias("a"), kinds.alias("b"), [("a.q", "b.q")], null_safe=True)
    return op.aggregate(pairs, [("a.q", "q")], [Aggregate("count", name="n")])


FRAMES = {
    "df_scan_filter_project": (df_scan_filter_project, "SELECT l_orderkey, l_extendedprice * 2 AS double_price, l_partkey // 10 AS bin FROM lineitem WHERE l_quantity >= 49 AND l_tax < l_discount"),
    "df_join_aggregate_top": (df_join_aggregate_top, "SELECT c_mktsegment, COUNT(*) AS orders, MAX(o_totalprice) AS largest, COUNT(DISTINCT o_custkey) AS customers FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment ORDER BY orders DESC, c_mktsegment LIMIT 3"),
    "df_join_null_safe": (df_join_null_safe, "SELECT a.q, COUNT(*) AS n FROM (SELECT NULLIF(quality, 0) AS q FROM labels) a JOIN (SELECT DISTINCT NULLIF(quality, 0) AS q FROM labels) b ON a.q IS NOT DISTINCT FROM b.q GROUP BY a.q"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _sql_query(tables, sql, DEALT.get(name, ())) for name, (tables, sql, _) in SQL.items()}
QUERIES |= {name: run for name, (run, _) in FRAMES.items()}
ORACLES: dict[str, str] = {name: (other or sql).replace("TIMESTAMP_NTZ '", "TIMESTAMP '") for name, (_, sql, other) in SQL.items()}
ORACLES |= {name: sql for name, (_, sql) in FRAMES.items()}
