"""Aggregate operators A1–A11.

All aggregates are hash aggregates with a partial (map-side) phase, so a hot
group key costs one partial row per input partition, never a whole group in
one task.  Fan-out is avoided by aggregating every child table on its own key
before any join (A6), the rule the reference needs COUNT(DISTINCT) for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capped(df: DataFrame, k: int | None) -> DataFrame:
    """The first ``k`` rows of an ordered frame; all of them when ``k`` is None."""
    return df if k is None else df.limit(k)


def group_count(df: DataFrame, by: str | Column | Sequence[str | Column], out: str = "cnt",
                ci: bool = False) -> DataFrame:
    """A2: rows per group (NULL is a group of its own).

    ``ci=True`` groups string keys case- and accent-insensitively (N1) and
    reports the smallest original spelling of each group.
    """
    keys = [by] if isinstance(by, (str, Column)) else list(by)
    if ci and all(isinstance(k, str) for k in keys):
        from sitelens.functions.text import ci_key
        g = df.groupBy(*[ci_key(k).alias(f"__ci{i}") for i, k in enumerate(keys)])
        return g.agg(*[F.min(k).alias(k) for k in keys], F.count(F.lit(1)).alias(out)).drop(
            *[f"__ci{i}" for i in range(len(keys))])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def per_key(child: DataFrame, key: str, aggs: Sequence[Column], where: Column | None = None) -> DataFrame:
    """Aggregate one child table by its foreign key (NULL keys dropped)."""
    c = child.where(F.col(key).isNotNull())
    if where is not None:
        c = c.where(where)
    return c.groupBy(key).agg(*aggs)


def branch_aggregate(base: DataFrame, key: str,
                     branches: Sequence[tuple[DataFrame, str, Sequence[Column]]],
                     fill: dict[str, object] | None = None) -> DataFrame:
    """One row per ``base`` key with aggregates of several child tables.

    Each branch ``(child, child_fk, aggs)`` is aggregated by its foreign key
    first and then left-joined, so children never multiply each other.
    ``fill`` gives defaults for entities without children (e.g. counts → 0).
    """
    out = base
    for child, fk, aggs in branches:
        a = per_key(child, fk, aggs).withColumnRenamed(fk, "__fk")
        out = out.join(a, F.col(key) == F.col("__fk"), "left").drop("__fk")
    if fill:
        out = out.fillna(fill)
    return out


def avg_of_avgs(df: DataFrame, group: str, value: Column, drop_null_group: bool = False) -> DataFrame:
    """Average of per-group averages; the NULL group counts (as in the reference)."""
    d = df.where(F.col(group).isNotNull()) if drop_null_group else df
    per = d.groupBy(group).agg(value.alias("__g"))
    return per.agg(F.avg("__g").alias("avg_of_avgs"))
