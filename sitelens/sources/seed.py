"""R2: ingest of raw seed/export tables into the role schemas, with repairs.

Raw inputs (CSV or Parquet written by older tools) use drifting column names
and types; ``normalise_seed`` maps them onto ``ROLE_SCHEMAS``: known aliases
are renamed, values cast (failed casts become NULL), absent columns become
NULL, unknown columns are dropped.  Optional growth columns (latitude,
longitude, experience_years …) are kept when ``keep_extra`` names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.sources.roles import ROLE_SCHEMAS

# Column-name drift seen in the reference's scripts, old name → role column.
ALIASES = {
    "visitors": {"name": "full_name"},
    "guides": {"name": "full_name"},
    "bookings": {"total_price": "booked_ticket_price"},
    "payments": {"payment_date": "paid_at"},
    "assignments": {"assignment_id": "assign_id"},
}


def normalise_seed(df: DataFrame, role: str, keep_extra: tuple[str, ...] = ()) -> DataFrame:
    """Map a raw table onto the role schema (rename aliases, cast, fill, drop)."""
    schema = ROLE_SCHEMAS[role]
    renames = {old: new for old, new in ALIASES.get(role, {}).items()
               if old in df.columns and new not in df.columns}
    for old, new in renames.items():
        df = df.withColumnRenamed(old, new)
    cols = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType))
            .alias(f.name) for f in schema.fields]
    extra = [F.col(f"`{c}`") for c in keep_extra if c in df.columns]
    return df.select(*cols, *extra)


def read_seed_csv(spark: SparkSession, path: str, role: str, **options) -> DataFrame:
    """Read a raw CSV (all strings, header row) and normalise it to ``role``."""
    raw = spark.read.option("header", True).options(**options).csv(path)
    return normalise_seed(raw, role)
