"""Parquet sink for the result tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """One folder per table, replaced as a whole; split by year where there is one."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if "year" in table.columns:
            writer = writer.partitionBy("year")
        writer.parquet(f"{path}/{name}")
