"""

MySQL keeps DECIMAL arithmetic exact: SUM(DECIMAL(10,2)) stays at scale 2 and
AVG adds four digits of scale.  Spark's decimal aggregates do the same, so the
engine keeps money in decimals and fixes the result types explicitly, which
also makes them comparable with other engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUM_T = "decimal(20,2)"


def as_dec(c: Column | str, p: int = 14, s: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({p},{s})")


def sum2(c: Column | str) -> Column:
    """SUM of a DECIMAL(10,2) money column, typed DECIMAL(20,2)."""
    return F.sum(c).cast(SUM_T)


def avg_exact(c: Column | str) -> Column:
    """AVG of a DECIMAL(10,2) column, exact to scale 6 (MySQL: scale + 4)."""
    return F.avg(c).cast("decimal(14,6)")


def ravg(c: Column | str, n: int = 2) -> Column:
    """ROUND(AVG(decimal), n), half-up on the exact average."""
    return F.round(F.avg(c), n).cast(f"decimal(14,{n})")


def avg_int(c: Column | str) -> Column:
    """AVG of an integer column as MySQL gives it: exact decimal, scale 4."""
    col = F.col(c) if isinstance(c, str) else c
    return F.avg(col.cast("decimal(18,0)")).cast("decimal(14,4)")


def ravg_int(c: Column | str, n: int = 2) -> Column:
    """ROUND(AVG(int), n) on the exact scale-4 average."""
    return F.round(avg_int(c), n).cast(f"decimal(14,{n})")
