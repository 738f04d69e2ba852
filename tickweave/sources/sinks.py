"""Writing results: partitioned Parquet for tables, CSV and JSON for small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table; rows of one partition value are brought together first to avoid tiny files.

    AQE splits a partition value that is too large for one file.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, sort: Sequence[str] = ()) -> None:
    """Bucketed table for repeated joins on the same key without a shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys)
    if sort:
        writer = writer.sortBy(*sort)
    writer.saveAsTable(table)
