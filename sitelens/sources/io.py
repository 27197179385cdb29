"""Sources and sinks: K1 CSV export, K2 filtered export, K3 JSON series, versioned tables.

Every sink writes one part file per partition from the executors; nothing is
funnelled through the driver or a single task.  Writers take an explicit
output folder (on a cluster, a shared file system or object store path).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def export_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> str:
    """K1: CSV with a header line per part file (RFC 4180 quoting)."""
    df.write.mode(mode).option("header", header).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K3: JSON lines (one object per row), as the API series endpoint returns."""
    df.write.mode(mode).json(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_version(df: DataFrame, base: str, version: str | None = None) -> str:
    """Write a version of a table under ``base/v=<version>``.

    Jobs that rewrite a table (upserts, deletes) write a new version instead
    of touching the one they read; readers switch once the write finished.
    Re-running a job with the same version id replaces that version, so a
    retried job is idempotent.
    """
    v = version or time.strftime("%Y%m%d%H%M%S")
    path = f"{base.rstrip('/')}/v={v}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a CSV export back with a declared schema (no inference)."""
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
