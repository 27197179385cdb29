"""Benchmark: run the headline catalogue queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through Spark's ``noop`` sink (every row is
produced, nothing is collected to the driver).  Each query runs three times
and the fastest run is reported, so one-off JVM/codegen warm-up of a new
plan shape and machine noise are not counted (``BENCH_RUNS`` overrides).  Prints one JSON line: {"metric", "value", "unit",
"queries", "sf"}.

    BENCH_SF_DIR=/root/testdata/sf0.01 python bench.py          # headline set
    python bench.py --all                                         # every query
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitelens.plans import REGISTRY  # noqa: E402
from sitelens.session import get_spark  # noqa: E402
from sitelens.sources.roles import load_roles  # noqa: E402

# One or two queries per operator family: joins (semi/anti/outer/polymorphic),
# fan-out-safe aggregates, windows (rank, latest, per-group top-k), set ops,
# self-join top pairs, NOT IN, full-text, listings, jobs, streaming core.
HEADLINE = [
    "c_x11_site_revenue", "c_x16_rank_sites_by_price", "c_x17_view_sites_summary",
    "c_x18_sites_in_bookings_not_in_reviews", "c_s16_except_emulation", "c_s18_inner_join_bookings_payments",
    "c_s23_self_join_guides", "c_s29_bookings_by_nationality", "c_e08_capacity_stats_unesco",
    "c_e13_minus_emulation", "c_e14_view_like_revenue_summary", "c_e22_self_join_example",
    "c_a14_inner_join_assignments", "c_p03_payments_last_10", "c_p04_monthly_revenue",
    "c_v04_visitors_high_avg_rating", "c_v07_recent_reviews", "d03_overall_avg_rating",
    "d13_bookings_by_month", "d23_site_latest_reviews", "d24_site_page_aggregates", "d26_related_sites",
    "d27_booking_detail_latest_payment", "d31_filter_facets", "b08d_full_join_sites_events",
    "b13e_intersect_booked_reviewed_events", "l6_payment_list_page", "l7_visitor_list",
    "f8_fulltext_documents", "f8i_fulltext_documents_index", "m1_booking_intake", "m2_payment_settlement",
    "m6_reconciliation", "t3_daily_bookings_revenue",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(REGISTRY) if "--all" in sys.argv else HEADLINE
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=parts)
    roles = load_roles(spark, sf_dir)
    # Warm-up: JVM, file listing and codegen caches.
    REGISTRY["c_x03_price_aggregates"].fn(roles).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name in names:
        best = float("inf")
        for _ in range(runs):
            t0 = time.perf_counter()
            REGISTRY[name].fn(roles).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        timings[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec" if names is HEADLINE else "all_queries_total_sec",
                      "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "n_queries": len(timings)}))


if __name__ == "__main__":
    main()
