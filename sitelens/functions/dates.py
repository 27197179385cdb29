"""Calendar helpers (A8, F7).  'now' is always an explicit ``as_of`` date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_bucket(c: Column | str) -> Column:
    """DATE_FORMAT(col, '%Y-%m')."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM")


def day_lit(d: dt.date | str) -> Column:
    return F.lit(str(d)).cast("date")


def ts_lit(d: dt.date | dt.datetime | str) -> Column:
    return F.lit(str(d)).cast("timestamp_ntz")


def months_before(as_of: dt.date, n: int) -> Column:
    """DATE_SUB(as_of, INTERVAL n MONTH), clamped to month end like MySQL."""
    return F.add_months(day_lit(as_of), -n)
