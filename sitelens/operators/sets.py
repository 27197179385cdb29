"""Set operators U1–U5 (by column position, as SQL does)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.operators.joins import anti, semi


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """UNION (distinct). Column names come from the first input."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.union(d)
    return out.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """INTERSECT (distinct, NULL-safe).

    Spark plans it as a NULL-safe semi join; ``b`` is deduplicated first so a
    hot row of ``b`` is shipped once per map task (partial aggregate).
    """
    return a.intersect(b.distinct())


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """EXCEPT (distinct, NULL-safe); ``b`` deduplicated first like in :func:`intersect`."""
    return a.subtract(b.distinct())


def intersect_by_key(base: DataFrame, key: str, *others: tuple[DataFrame, str]) -> DataFrame:
    """U4: rows of ``base`` whose key occurs in every other table (chained semi joins)."""
    out = base
    for df, k in others:
        out = semi(out, df, key, right_key=k)
    return out


def except_by_key(base: DataFrame, key: str, *others: tuple[DataFrame, str]) -> DataFrame:
    """Rows of ``base`` whose key occurs in none of the other tables (anti joins)."""
    out = base
    for df, k in others:
        out = anti(out, df, key, right_key=k)
    return out
