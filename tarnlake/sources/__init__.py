"""Where tables come from: folders of Parquet files."""

from tarnlake.sources.catalog import Catalog, read_schema
from tarnlake.sources.pruning import RowGroupPruneStats, prune_row_groups

__all__ = ["Catalog", "RowGroupPruneStats", "prune_row_groups", "read_schema"]
