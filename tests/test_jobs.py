"""Write jobs M1–M10: rules on the seed fixture, properties, brute-force checks."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from sitelens.jobs import intake
from sitelens.jobs.reconcile import reconciliation
from sitelens.jobs.referential import apply_deletes
from sitelens.jobs.upsert import delete_where, update_where, upsert
from sitelens.sources import requests as rq
from sitelens.streaming.intake import BOOKING_REQUEST_SCHEMA

TS = dt.datetime(2001, 8, 2, 9, 0)


def _req(spark, rows):
    schema = BOOKING_REQUEST_SCHEMA.simpleString().replace("ts:timestamp", "ts:timestamp_ntz")
    return spark.createDataFrame(rows, schema)


def test_booking_intake_rules(spark, seed):
    rows = [
        (1, TS, 100, None, None, None, 1, None, 0, " CARD "),        # ok: tickets clamped to 1, method card
        (2, TS, 100, None, None, None, None, None, 2, "bkash"),     # no target
        (3, TS, 100, None, None, None, 77, None, 1, "bkash"),       # unknown site
        (4, TS, 100, None, None, None, 1, 10, 1, "bkash"),          # both targets
        (5, TS, None, "Guest", "guest@x.org", "1", None, 12, 3, "paypal"),  # new guest, event, method→bkash
        (6, TS, None, "Guest2", "guest@x.org", "2", 4, None, 1, None),     # same new email → same visitor
        (7, TS, None, "", "alice@example.com", None, 1, None, 1, "nagad"),  # guest without name
        (8, TS, None, "Al", "alice@example.com", None, 4, None, 2, "nagad"),  # existing email → visitor 100
    ]
    res = intake.booking_intake(seed, _req(spark, rows))
    rej = {r["request_id"]: r["reject_reason"] for r in res.rejects.collect()}
    assert rej == {2: "no_target", 3: "site_not_found", 4: "both_targets", 7: "guest_name_email_required"}
    b = {r["booking_date"]: None for r in res.accepted.collect()}
    acc = sorted(res.accepted.collect(), key=lambda r: r["booking_id"])
    assert [r["booking_id"] for r in acc] == [1008, 1009, 1010, 1011]       # dense after max 1007
    assert [str(r["booked_ticket_price"]) for r in acc] == ["50.00", "600.00", "0.00", "0.00"]
    assert acc[1]["visitor_id"] == acc[2]["visitor_id"] == 104               # one new guest visitor
    assert acc[3]["visitor_id"] == 100
    pay = {r["booking_id"]: r["method"] for r in res.extra["payments"].collect()}
    assert pay == {1008: "card", 1009: "bkash", 1010: "bkash", 1011: "nagad"}
    nv = res.extra["visitors"].collect()
    assert [(r["visitor_id"], r["full_name"]) for r in nv] == [(104, "Guest")]
    assert b is not None


def test_payment_settlement(spark, seed):
    att = spark.createDataFrame([
        (1, TS, 1001, "Card"),                      # settles 1001: updates its latest payment
        (2, TS + dt.timedelta(hours=1), 1001, "bkash"),   # later attempt → already paid
        (3, TS, 1000, "card"),                      # booking already paid
        (4, TS, 1005, "paypal"),                    # invalid method
        (5, TS + dt.timedelta(hours=1), 1005, "nagad"),   # settles 1005 (no payment yet → initiated row)
        (6, TS, 4242, "card"),                      # unknown booking
    ], "request_id long, ts timestamp_ntz, booking_id long, method string")
    res = intake.payment_settlement(seed, att)
    rej = {r["request_id"]: r["reject_reason"] for r in res.rejects.collect()}
    assert rej == {2: "already_paid", 3: "already_paid", 4: "invalid_method", 6: "booking_not_found"}
    pay = res.extra["payments"]
    p1001 = pay.where("booking_id = 1001").collect()
    assert [(r["status"], r["method"], str(r["amount"])) for r in p1001] == [("successful", "card", "50.00")]
    p1005 = pay.where("booking_id = 1005").collect()
    assert [(r["status"], r["method"]) for r in p1005] == [("initiated", "nagad")]
    assert pay.count() == seed.payments.count() + 1
    st = {r["booking_id"]: r["payment_status"] for r in res.extra["bookings"].collect()}
    assert st[1001] == "paid" and st[1005] == "paid" and st[1004] == "pending"


def test_settlement_updates_one_of_equal_payments(spark, seed):
    copies = seed.payments.withColumn("payment_id", F.col("payment_id") + 1000)      # equal but for their key
    twice = seed.with_tables(payments=seed.payments.unionByName(copies))
    att = spark.createDataFrame([(1, TS, 1001, "Card")],
                                "request_id long, ts timestamp_ntz, booking_id long, method string")
    before = [r["status"] for r in twice.payments.where("booking_id = 1001").collect()]
    pay = intake.payment_settlement(twice, att).extra["payments"]
    after = [r["status"] for r in pay.where("booking_id = 1001").collect()]
    assert len(after) == len(before) == 2 and after.count("successful") == before.count("successful") + 1
    assert pay.count() == twice.payments.count()


def test_review_and_signup_intake(spark, seed):
    rv = spark.createDataFrame([(1, TS, 100, 1, None, 9, "  nice  "), (2, TS, 100, None, None, 3, "x"),
                                (3, TS, 101, 1, 10, 3, "x"), (4, TS, 102, None, 12, None, "y")],
                               "request_id long, ts timestamp_ntz, visitor_id long, site_id long, event_id long, "
                               "rating int, comment string")
    res = intake.review_intake(seed, rv)
    got = sorted((r["review_id"], r["rating"], r["comment"]) for r in res.accepted.collect())
    assert got == [(5, 5, "nice"), (6, 5, "y")]
    su = spark.createDataFrame([(1, TS, " Dan ", " DAN@x.org ", "1", "BD"), (2, TS, "Dan2", "dan@x.org", "2", "BD"),
                                (3, TS, "Eve", "bad-email", "3", "BD"), (4, TS, "Al", "alice@example.com", "4", "BD"),
                                (5, TS, "  ", "z@x.org", "5", "BD")],
                               "request_id long, ts timestamp_ntz, full_name string, email string, phone string, "
                               "nationality string")
    res = intake.visitor_registration(seed, su)
    assert [(r["visitor_id"], r["email"], r["full_name"]) for r in res.accepted.collect()] == [(104, "dan@x.org", "Dan")]
    rej = {r["request_id"]: r["reject_reason"] for r in res.rejects.collect()}
    assert rej == {2: "email_exists", 3: "invalid_email", 4: "email_exists", 5: "required_field_missing"}


def test_signup_first_valid_request_wins(spark, seed):
    su = spark.createDataFrame([(1, TS, "  ", "eve@x.org", "1", "BD"), (2, TS, "Eve", "EVE@x.org", "2", "BD")],
                               "request_id long, ts timestamp_ntz, full_name string, email string, phone string, "
                               "nationality string")
    res = intake.visitor_registration(seed, su)
    assert [(r["full_name"], r["email"]) for r in res.accepted.collect()] == [("Eve", "eve@x.org")]
    assert {r["request_id"]: r["reject_reason"] for r in res.rejects.collect()} == {1: "required_field_missing"}


def test_upsert_idempotent_and_latest_wins(spark, seed):
    ch = spark.createDataFrame([(1, "upsert", TS, "R1", None), (1, "upsert", TS + dt.timedelta(1), "R2", None),
                                (2, "delete", TS, None, None), (9, "upsert", TS, "New", Decimal("1.00"))],
                               "guide_id long, op string, ts timestamp_ntz, full_name string, salary decimal(10,2)")
    once = upsert(seed.guides, ch, ["guide_id"], keep_old=["salary"])
    twice = upsert(once, ch, ["guide_id"], keep_old=["salary"])
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    got = {r["guide_id"]: (r["full_name"], r["salary"]) for r in once.collect()}
    assert 2 not in got and got[1] == ("R2", Decimal("40000.00")) and got[9][0] == "New"


def test_update_delete_keep_null_predicate_rows(spark):
    df = spark.createDataFrame([(1, 5), (None, 6)], "k long, v int")
    assert sorted(r["v"] for r in update_where(df, F.col("k") == 1, {"v": F.lit(9)}).collect()) == [6, 9]
    assert [r["v"] for r in delete_where(df, F.col("k") == 1).collect()] == [6]


def test_referential_actions(seed):
    res = apply_deletes(seed, sites=seed.sites.where("site_id = 1").select("site_id"),
                        visitors=seed.visitors.where("visitor_id IN (100, 103)").select("visitor_id"))
    r = res.roles
    assert r.evts.where("site_id = 1").count() == 0                     # cascade
    assert r.bookings.where("site_id = 1").count() == 0                 # set null
    conf = sorted((c["table_name"], c["row_id"]) for c in res.conflicts.collect())
    # bookings 1000, 1001 lose their only target (site 1); event 10 cascaded → 1002 too; assignments 1, 2, 4.
    assert ("bookings", 1000) in conf and ("bookings", 1002) in conf and ("assignments", 2) in conf
    assert [x["key"] for x in res.refused.collect()] == [100]            # restrict: visitor 100 has bookings
    assert r.visitors.where("visitor_id = 103").count() == 0


def test_reconciliation_findings(seed):
    got = sorted((r["finding"], r["key"]) for r in reconciliation(seed).collect())
    assert ("paid_twice", 1002) in got
    assert ("payment_without_booking", 9999) in got
    assert ("amount_mismatch", 1007) in got
    assert ("paid_without_successful_payment", 1003) in got
    assert ("initiated_but_paid", 1003) in got
    assert ("sold_out", 13) in got


def test_method_domain_growth(spark, roles):
    res = intake.method_domain_growth(intake.method_domain(spark), rq.method_requests(spark, roles.extra["sf_dir"]))
    codes = [r["code"] for r in res.accepted.orderBy("position").collect()]
    assert codes[:5] == intake.ALLOWED_METHODS and all(c.startswith("wallet_") for c in codes[5:])
    assert len(set(codes)) == len(codes)
    again = intake.method_domain_growth(res.accepted, rq.method_requests(spark, roles.extra["sf_dir"]))
    assert again.accepted.count() == res.accepted.count()                # idempotent


def test_booking_intake_on_driver_requests_brute_force(spark, roles):
    req = rq.booking_requests(spark, roles.extra["sf_dir"])
    res = intake.booking_intake(roles, req)
    n_req, n_ok, n_rej = req.count(), res.accepted.count(), res.rejects.count()
    assert n_ok + n_rej == n_req
    ids = [r["booking_id"] for r in res.accepted.select("booking_id").collect()]
    start = roles.bookings.agg(F.max("booking_id")).collect()[0][0]
    assert sorted(ids) == list(range(start + 1, start + 1 + n_ok))
    pdf = req.toPandas()
    no_target = int((pdf.site_id.isna() & pdf.event_id.isna()).sum())
    assert res.rejects.where("reject_reason = 'no_target'").count() == no_target
