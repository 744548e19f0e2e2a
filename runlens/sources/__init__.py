"""Where tables come from."""

from runlens.sources.readers import jdbc_options, month_coverage, read_jdbc, read_parquet, read_table, write_by_month
from runlens.sources.registry import SourceRegistry, Tables

__all__ = [
    "SourceRegistry",
    "Tables",
    "jdbc_options",
    "month_coverage",
    "read_jdbc",
    "read_parquet",
    "read_table",
    "write_by_month",
]
