from .readers import RawTables, land_parquet, load_parquet, oversized_files, quarantined, read_csv, read_jdbc, split_quarantine
from .sinks import read_report, register_views, write_fact, write_report, write_table
from .star import load_star, star_tables

__all__ = [
    "RawTables",
    "land_parquet",
    "load_parquet",
    "load_star",
    "oversized_files",
    "quarantined",
    "read_csv",
    "read_jdbc",
    "read_report",
    "register_views",
    "split_quarantine",
    "star_tables",
    "write_fact",
    "write_report",
    "write_table",
]
