"""M6: reconciliation report between bookings, payments and event capacity.

Checks (one tagged row per finding):

* ``paid_without_successful_payment`` — booking marked paid, no successful payment;
* ``payment_without_booking``         — payment whose booking does not exist;
* ``amount_mismatch``                  — successful amount total ≠ booked price;
* ``paid_twice``                       — more than one successful payment;
* ``initiated_but_paid``               — booking paid while its payments are only initiated;
* ``sold_out``                         — event with more bookings than capacity.

Payments are aggregated per booking first (partial aggregates), then meet
the bookings in one full outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.aggs import per_key
from sitelens.sources.roles import Roles


def reconciliation(r: Roles, success: str = "successful") -> DataFrame:
    ok = F.col("status") == success
    per = r.payments.groupBy("booking_id").agg(
        F.count(F.lit(1)).alias("n_payments"),
        F.count(F.when(ok, 1)).alias("n_success"),
        F.sum(F.when(ok, F.col("amount"))).cast("decimal(20,2)").alias("success_amount"),
        F.count(F.when(F.col("status") == "initiated", 1)).alias("n_initiated"))
    b = r.bookings.select(F.col("booking_id").alias("__bid"), "payment_status", "booked_ticket_price")
    j = per.join(b, F.col("booking_id") == F.col("__bid"), "full")
    key = F.coalesce("booking_id", "__bid")
    n_success = F.coalesce("n_success", F.lit(0))
    checks = [
        ("paid_without_successful_payment", F.col("__bid").isNotNull() & (F.col("payment_status") == "paid")
         & (n_success == 0)),
        ("payment_without_booking", F.col("__bid").isNull()),
        ("amount_mismatch", F.col("__bid").isNotNull() & (n_success > 0)
         & (F.col("success_amount") != F.col("booked_ticket_price"))),
        ("paid_twice", n_success > 1),
        ("initiated_but_paid", (F.col("payment_status") == "paid") & (n_success == 0)
         & (F.coalesce("n_initiated", F.lit(0)) > 0)),
    ]
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    found = (j.select(key.alias("key"), tags.alias("__t")).where(F.size("__t") > 0)
             .select(F.explode("__t").alias("finding"), "key"))
    booked = per_key(r.bookings, "event_id", [F.count(F.lit(1)).alias("__n")])
    sold = (r.evts.where(F.col("capacity") > 0).join(booked, "event_id")
            .where(F.col("__n") > F.col("capacity")).select(F.lit("sold_out").alias("finding"),
                                                             F.col("event_id").alias("key")))
    return found.unionByName(sold)
