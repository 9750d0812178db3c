"""Job-market analytics on Spark: clean postings, filter them, report on them."""

from .operators.filters import FilterSpec, apply_filters
from .plans.cleaning import clean_postings
from .plans.dashboard import collect_all, dashboard, reports
from .schema import POSTINGS, PostingColumns
from .sources.clean_store import (
    build_clean,
    ensure_clean,
    kept,
    read_clean,
    stored_bounds,
    write_clean,
)
from .sources.raw_csv import lines_are_closed, read_csv_where, read_raw_csv, write_csv

__all__ = [
    "POSTINGS",
    "FilterSpec",
    "PostingColumns",
    "apply_filters",
    "build_clean",
    "clean_postings",
    "collect_all",
    "dashboard",
    "ensure_clean",
    "kept",
    "lines_are_closed",
    "read_clean",
    "read_csv_where",
    "read_raw_csv",
    "reports",
    "stored_bounds",
    "write_clean",
    "write_csv",
]
