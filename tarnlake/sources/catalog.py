"""A folder as a catalog: each ``NAME.parquet`` (a file, or a folder of part files) is a table.

The folder is listed through Spark's file systems, so it may lie in any store that Spark reads.
Schemas come from the Parquet footers; nothing is inferred from data or declared by users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnlake.errors import PlanError, StorageError, translated

SUFFIX = ".parquet"


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema in a file's footer; every field is nullable."""
    with translated():
        return spark.read.parquet(path).schema


class Catalog:
    """Tables of a folder. Other files and nested folders without the suffix are passed over."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            raise StorageError(f"no such folder: {folder}")
        found = (s.getPath().getName() for s in files.listStatus(path))
        self.names = sorted(n[: -len(SUFFIX)] for n in found if n.endswith(SUFFIX))
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}{SUFFIX}"

    def table(self, name: str) -> DataFrame:
        """The table as a DataFrame; of a dotted name the last part counts."""
        name = name.rpartition(".")[2]
        if name not in self.names:
            raise PlanError(f"unknown table {name}; the folder has {', '.join(self.names) or 'none'}")
        if name not in self._frames:
            with translated():
                self._frames[name] = self.spark.read.parquet(self.path(name))
        return self._frames[name]

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema

    def register(self, *names: str) -> Catalog:
        """Temporary views of the named tables, or of all."""
        for name in names or self.names:
            self.table(name).createOrReplaceTempView(name)
        return self
