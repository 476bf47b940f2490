"""Every relational query against its DuckDB SQL, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from compare import canonical, oracle_frame
from tarnlake import operators as op
from tarnlake import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_duckdb(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), oracle_frame(queries.ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tasks_of_multi_key_join_are_bounded(spark, tmp_path):
    """More rows take more tasks, not larger ones, whatever the session's number of partitions."""
    n = 8 * op.TASK_ROWS
    keys = spark.range(n).selectExpr("id % 700001 AS l_orderkey", "CAST(id % 3 AS INT) AS l_linenumber")
    keys.union(spark.sql("SELECT NULL, 1 UNION ALL SELECT 7, NULL")).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = queries.QUERIES["join_multi_key"](spark, str(tmp_path))
    tasks = got.groupBy(F.spark_partition_id()).agg(F.sum(F.sqrt("pairs")).cast("long").alias("n")).collect()
    assert sum(t.n for t in tasks) == n  # a key of m rows has m * m pairs; null keys match nothing
    assert max(t.n for t in tasks) < 1.5 * op.TASK_ROWS
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert "Repartition" not in spark.table("lineitem")._jdf.queryExecution().optimizedPlan().toString()
    want = oracle_frame(queries.ORACLES["join_multi_key"], str(tmp_path))
    assert (got.count(), got.agg(F.sum("pairs")).first()[0]) == (len(want), want.pairs.sum())
