"""M5: schema change on a table (ADD / RENAME / MODIFY / DROP column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_column(df: DataFrame, name: str, dtype: str, default=None) -> DataFrame:
    """ALTER TABLE … ADD name dtype [DEFAULT default]."""
    return df.withColumn(name, F.lit(default).cast(dtype))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """ALTER TABLE … RENAME COLUMN old TO new."""
    return df.withColumnRenamed(old, new)


def modify_column(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """ALTER TABLE … MODIFY name dtype (values cast; failures become NULL)."""
    return df.withColumn(name, F.col(name).try_cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """ALTER TABLE … DROP COLUMN name."""
    return df.drop(name)
