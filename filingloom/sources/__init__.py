"""Readers that yield the corpus table, and writers for filings and result tables."""

from filingloom.sources.files import flat_name, tree_name, write_files
from filingloom.sources.filings import (
    extract_filings,
    flat_filings,
    from_table,
    read_filings,
    read_flat,
)
from filingloom.sources.results import write_results

__all__ = [
    "extract_filings",
    "flat_filings",
    "flat_name",
    "from_table",
    "read_filings",
    "read_flat",
    "tree_name",
    "write_files",
    "write_results",
]
