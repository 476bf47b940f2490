"""The same SELECTs over folders that grow: a table's new files as an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import Aggregate
from tarnlake.plans.sql import parse


def stream_table(spark: SparkSession, folder: str, name: str, time: str | None = None, late: str = "0 seconds", most_files: int | None = None) -> DataFrame:
    """A streaming view of ``folder`` (part files of one schema, which the files there now give).
    With time, that column's watermark: rows more than ``late`` behind the latest are dropped from
    aggregates, whose state is bounded by it. most_files bounds the files of a micro-batch."""
    schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    df = (reader if most_files is None else reader.option("maxFilesPerTrigger", most_files)).parquet(folder)
    if time is not None:
        df = df.withWatermark(time, late)
    df.createOrReplaceTempView(name)
    return df


def stream_sql(spark: SparkSession, sql: str) -> DataFrame:
    """A query over streaming views; commands are refused as in ``run_sql``. Write it with
    ``writeStream`` (complete or update mode for aggregates)."""
    parse(spark, sql)
    return spark.sql(sql)


def windowed(df: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Aggregate], step: str | None = None) -> DataFrame:
    """Aggregates by window of event time (tumbling; sliding with a step) and keys: window_start,
    window_end, the keys and the aggregates. The same over tables and over streams; a stream with
    a watermark can append each window once it is closed."""
    grouped = df.groupBy(F.window(time, width, step), *keys).agg(*[a.column() for a in aggregates])
    names = [a.name or a.function.lower() for a in aggregates]
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *names)
