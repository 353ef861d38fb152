"""Sinks for result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_table(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result table; CSV gets a header and ``NA`` for missing values."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    writer.format(fmt).save(path)
