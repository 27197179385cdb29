"""R1 alternative source: role tables read from a relational database over JDBC.

Reads are split into ``partitions`` parallel range queries on the table's
numeric key (``partitionColumn`` / ``lowerBound`` / ``upperBound``), so no
single task pulls a whole table.  The bounds only shape the split; rows
outside them still go to the first/last partition.

Not exercised by the tests: no database server is reachable in the build
environment (the driver URL and credentials come from the caller).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.sources.roles import ROLE_BUCKETS, Roles
from sitelens.sources.seed import normalise_seed

ROLE_KEYS = {"sites": "site_id", "evts": "event_id", "visitors": "visitor_id", "bookings": "booking_id",
             "payments": "payment_id", "guides": "guide_id", "assignments": "assign_id", "reviews": "review_id"}


def read_table_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
                    partitions: int, properties: dict[str, str]) -> DataFrame:
    """One table as ``partitions`` parallel key-range reads."""
    return spark.read.jdbc(url=url, table=table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


def jdbc_roles(spark: SparkSession, url: str, properties: dict[str, str], tables: dict[str, str],
               bounds: dict[str, tuple[int, int]], partitions: int = 64) -> Roles:
    """All eight roles over JDBC, normalised to the role schemas (R2 repairs included).

    ``tables`` maps each role name to the source table that holds it.
    """
    frames = {}
    for role, table in tables.items():
        lo, hi = bounds.get(role, (0, 1))
        raw = read_table_jdbc(spark, url, table, ROLE_KEYS[role], lo, hi, partitions, properties)
        frames[role] = normalise_seed(raw, role)
    assert set(frames) == set(ROLE_BUCKETS)
    return Roles(**frames)
