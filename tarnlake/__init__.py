"""tarnlake: SQL SELECT analytics over a directory of Parquet files, planned and run by Spark."""

__version__ = "0.1.0"
