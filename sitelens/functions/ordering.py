"""Ordering helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_order(c: Column | str, values: list[str]) -> Column:
    """FIELD(col, v1, v2, ...): 1-based position, 0 when absent (sorts first)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_position(F.array(*[F.lit(v) for v in values]), col)


def tie_break(*keys: str) -> list[Column]:
    """Ascending unique-key columns appended to an ORDER BY before a LIMIT."""
    return [F.col(k).asc() for k in keys]
