"""Snapshot history as Parquet tables partitioned by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Tables of a snapshot.
TABLES = ["runs", "pages", "findings", "families", "chunks", "claims", "opportunities"]


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Replaces the given tables' snapshots and leaves all others alone."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str, snapshot: str | None = None) -> DataFrame:
    """A table, or one snapshot of it: only that partition is read."""
    df = spark.read.parquet(f"{folder}/{name}")
    return df if snapshot is None else df.where(df["snapshot_id"] == snapshot)
