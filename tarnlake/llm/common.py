"""What the training-data operators share: tables in the shared folder, words, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of texts that a Python worker has on its hands at once (a longer text alone).
TEXT_ROWS = 500
TEXT_BYTES = 1 << 23

UPPER = bytes(range(65, 91))
#: Lower-cases A-Z and nothing else; UTF-8 bytes of other letters stay.
LOWER = bytes.maketrans(UPPER, UPPER.lower())
#: Lower-cases A-Z and turns every ASCII byte that isn't a letter or digit into a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
#: ASCII white space of the shingle operators.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session
    gets a temporary one; on a cluster that is an error, as no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there, and
    a lost executor costs no recomputation of what came before. Deleted when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    path = getattr(df, "settled_at", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in views of at most TEXT_ROWS rows and about TEXT_BYTES of a text column, so
    that what a worker makes of them is bounded too. (Spark bounds a batch's own bytes.)"""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            held = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, held + TEXT_BYTES, "right")))
            last = min(last, first + TEXT_ROWS, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


#: Bytes of a shuffle partition that tasks of this library aim at.
TASK_BYTES = 64 << 20


def task_count(spark: SparkSession, size: int) -> int:
    """Partitions for that many bytes: the session's number, and more where they would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(names: list[str]) -> list:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def ascii_lower(text):
    """Lower-case A-Z only. lower() is the same for pure ASCII and much faster there."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, lower)
    )


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
