"""How the NULL-key salt spreads a lookup shuffle (bookings → sites on site_id).

Spark's shuffle partition of a row is pmod(murmur3(join keys), n).  This
computes, for n partitions, the largest partition's share of all rows when
partitioning on site_id alone versus on (site_id, salt) as ``joins.lookup``
does.  A third of the bookings have a NULL site_id (event bookings).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from sitelens.operators.joins import salt_count  # noqa: E402
from sitelens.session import get_spark  # noqa: E402
from sitelens.sources.roles import load_roles  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    n = int(sys.argv[2]) if len(sys.argv) > 2 else 64
    spark = get_spark()
    b = load_roles(spark, sf_dir).bookings
    salt = F.when(F.col("site_id").isNull(), F.pmod(F.xxhash64("booking_id"), F.lit(salt_count(spark.range(1)))) + 1) \
        .otherwise(F.lit(0)).cast("bigint")
    parts = b.select(F.pmod(F.hash("site_id"), F.lit(n)).alias("plain"),
                     F.pmod(F.hash("site_id", salt), F.lit(n)).alias("salted"))
    total = parts.count()
    for col in ("plain", "salted"):
        mx = parts.groupBy(col).count().agg(F.max("count")).collect()[0][0]
        print(f"{col:7s} largest of {n} partitions: {mx} rows = {mx / total:.1%} (even share {1 / n:.1%})")


if __name__ == "__main__":
    main()
