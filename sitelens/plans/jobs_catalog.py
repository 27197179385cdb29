"""Write jobs M1..M10 registered as catalogue entries over derived request tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitelens.jobs import intake
from sitelens.jobs.reconcile import reconciliation
from sitelens.jobs.referential import apply_deletes
from sitelens.jobs.upsert import upsert
from sitelens.plans.registry import query
from sitelens.session import checkpoint_dir
from sitelens.sources import requests as rq
from sitelens.sources.roles import Roles
from sitelens.sources.snapshots import SnapshotTable
from sitelens.streaming.intake import (BOOKING_REQUEST_SCHEMA, PAYMENT_ATTEMPT_SCHEMA, daily_totals, dedupe_requests,
                                       start_booking_stream, start_payment_stream)
from sitelens.streaming.replay import replay
from sitelens.streaming.rollup import merge_days


_REQ_M1 = r"""
, req AS (
  SELECT o_orderkey AS request_id, o_orderdate + INTERVAL 1 DAY AS ts,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS visitor_id,
         TRIM(CASE WHEN o_orderkey % 7 = 0 THEN c_name END) AS name,
         TRIM(CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 19 <> 0 THEN
              CASE WHEN o_orderkey % 3 = 0 THEN c_name || '@Example.com'
                   WHEN o_orderkey % 4 = 0 THEN 'GUEST' || CAST(o_orderkey % 500 AS VARCHAR) || '@example.org'
                   ELSE 'guest' || CAST(o_orderkey % 500 AS VARCHAR) || '@example.org' END END) AS email,
         CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN -1 - o_orderkey
                   WHEN o_orderkey % 2 = 0 OR o_orderkey % 11 = 0 THEN o_custkey % (SELECT COUNT(*) FROM part)
              END AS BIGINT) AS site_id,
         CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL
                   WHEN o_orderkey % 2 = 1 OR o_orderkey % 11 = 0 THEN (o_orderkey * 3) % (SELECT COUNT(*) FROM events)
              END AS BIGINT) AS event_id,
         GREATEST(1, CAST(o_orderkey % 6 - 1 AS INT)) AS no_of_tickets
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
chk AS (
  SELECT q.*, s.ticket_price AS sp, e.ticket_price AS ep,
         CASE WHEN q.site_id IS NULL AND q.event_id IS NULL THEN 'no_target'
              WHEN q.site_id IS NOT NULL AND s.ticket_price IS NULL THEN 'site_not_found'
              WHEN q.site_id IS NULL AND e.ticket_price IS NULL THEN 'event_not_found'
              WHEN q.site_id IS NOT NULL AND q.event_id IS NOT NULL THEN 'both_targets'
              WHEN q.visitor_id IS NULL AND (q.name IS NULL OR TRIM(q.name) = '' OR q.email IS NULL OR TRIM(q.email) = '')
                THEN 'guest_name_email_required' END AS reject_reason
  FROM req q LEFT JOIN sites s ON s.site_id = q.site_id LEFT JOIN evts e ON e.event_id = q.event_id)"""

_GUESTS_M1 = r""",
ok AS (SELECT * FROM chk WHERE reject_reason IS NULL),
known AS (SELECT ok.request_id, MIN(v.visitor_id) AS vid FROM ok JOIN visitors v
          ON ok.visitor_id IS NULL AND LOWER(v.email) = LOWER(ok.email) GROUP BY ok.request_id),
fresh AS (SELECT LOWER(email) AS email, MIN(request_id) AS first_req FROM ok
          WHERE visitor_id IS NULL AND request_id NOT IN (SELECT request_id FROM known) GROUP BY LOWER(email)),
fresh_ids AS (SELECT email, (SELECT MAX(visitor_id) FROM visitors) + ROW_NUMBER() OVER (ORDER BY first_req) AS nvid
              FROM fresh)
"""

_SQL_M1 = _REQ_M1 + _GUESTS_M1 + r"""SELECT (SELECT MAX(booking_id) FROM bookings) + ROW_NUMBER() OVER (ORDER BY ok.request_id) AS booking_id,
       COALESCE(ok.visitor_id, k.vid, f.nvid) AS visitor_id, ok.site_id, ok.event_id, ok.ts AS booking_date,
       CAST(ok.no_of_tickets AS BIGINT) AS no_of_tickets,
       CAST(CASE WHEN ok.site_id IS NOT NULL THEN ok.sp ELSE ok.ep END * ok.no_of_tickets AS DECIMAL(10,2))
         AS booked_ticket_price,
       'pending' AS payment_status
FROM ok LEFT JOIN known k ON k.request_id = ok.request_id
LEFT JOIN fresh_ids f ON ok.visitor_id IS NULL AND k.vid IS NULL AND f.email = LOWER(ok.email)"""


_SQL_M1R = _REQ_M1 + r"""
SELECT request_id, ts, reject_reason FROM chk WHERE reject_reason IS NOT NULL"""


_SQL_M7 = r"""
, req AS (
  SELECT event_id AS request_id, ts, user_id AS visitor_id,
         CASE WHEN event_id % 13 <> 0 AND event_id % 2 = 0 THEN event_id % (SELECT COUNT(*) FROM part) END AS site_id,
         CASE WHEN event_id % 13 <> 0 AND (event_id % 2 = 1 OR event_id % 9 = 0) THEN event_id END AS event_id,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 8 - 1 AS INT) END AS rating,
         '  ' || event_type || ' review  ' AS comment
  FROM events WHERE event_type = 'purchase'),
ok AS (SELECT * FROM req WHERE NOT (site_id IS NULL AND event_id IS NULL)
                            AND NOT (site_id IS NOT NULL AND event_id IS NOT NULL))
SELECT (SELECT MAX(review_id) FROM reviews) + ROW_NUMBER() OVER (ORDER BY request_id) AS review_id,
       visitor_id, site_id, event_id, CAST(GREATEST(1, LEAST(5, COALESCE(rating, 5))) AS INT) AS rating,
       TRIM(comment) AS comment, CAST(ts AS DATE) AS review_date
FROM ok"""


_REQ_M8 = r"""
, req AS (
  SELECT c_custkey AS request_id, TIMESTAMP '2002-01-01 00:00:00' AS ts,
         TRIM(CASE WHEN c_custkey % 29 = 0 THEN '  ' ELSE ' ' || c_name END) AS full_name,
         LOWER(TRIM(CASE WHEN c_custkey % 23 = 0 THEN 'not-an-email'
                         WHEN c_custkey % 5 = 0 THEN 'DUP' || CAST(c_custkey % 40 AS VARCHAR) || '@Example.net  '
                         ELSE 'new' || CAST(c_custkey AS VARCHAR) || '@example.net' END)) AS email,
         TRIM(n_name) AS nationality
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
chk AS (
  SELECT q.*, CASE WHEN full_name IS NULL OR full_name = '' OR email IS NULL OR email = '' THEN 'required_field_missing'
                   WHEN NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'invalid_email'
                   WHEN EXISTS (SELECT 1 FROM visitors v WHERE LOWER(v.email) = q.email) THEN 'email_exists' END AS base
  FROM req q),
ranked AS (SELECT *, CASE WHEN base IS NULL THEN ROW_NUMBER() OVER (PARTITION BY email, base IS NULL
                                                                   ORDER BY ts, request_id) END AS rn FROM chk)
"""

_SQL_M8 = _REQ_M8 + r"""SELECT (SELECT MAX(visitor_id) FROM visitors) + ROW_NUMBER() OVER (ORDER BY request_id) AS visitor_id,
       full_name, nationality, email, CAST(ts AS DATE) AS created_at, '0180000000' AS phone
FROM ranked WHERE base IS NULL AND rn = 1"""


_SQL_M8R = _REQ_M8 + r"""SELECT request_id, ts, COALESCE(base, 'email_exists') AS reject_reason FROM ranked WHERE base IS NOT NULL OR rn > 1"""


_SQL_M9 = r"""
, req AS (
  SELECT c_custkey AS request_id, TIMESTAMP '2002-01-01 00:00:00' AS ts, TRIM(c_name) AS name,
         TRIM(CASE WHEN c_custkey % 6 = 0 THEN '' ELSE LOWER(c_name) || '@example.com' END) AS email,
         TRIM(CASE WHEN c_custkey % 4 = 0 THEN '   ' ELSE ' Hello from ' || c_mktsegment END) AS message
  FROM customer)
SELECT * FROM req WHERE NOT (email IS NULL OR email = '' OR message IS NULL OR message = '')"""


_SQL_M1V = _REQ_M1 + _GUESTS_M1 + r"""SELECT f.nvid AS visitor_id, o.name AS full_name, CAST(NULL AS VARCHAR) AS nationality, o.email,
       CAST(o.ts AS DATE) AS created_at, '0170000000' AS phone
FROM fresh_ids f JOIN fresh x ON x.email = f.email JOIN ok o ON o.request_id = x.first_req"""


_REQ_M2 = r"""
, att AS (
  SELECT o_orderkey * 2 AS request_id, o_orderdate + INTERVAL 2 DAY AS ts, o_orderkey AS booking_id,
         CASE WHEN o_orderkey % 9 = 0 THEN 'paypal' ELSE 'card' END AS method FROM orders
  UNION ALL
  SELECT o_orderkey * 2 + 1, o_orderdate + INTERVAL 3 DAY, o_orderkey, ' BKash' FROM orders WHERE o_orderkey % 5 = 0),
a AS (SELECT att.request_id, att.ts, att.booking_id, LOWER(TRIM(att.method)) AS method, b.booking_id AS bid,
             b.payment_status, b.booked_ticket_price
      FROM att LEFT JOIN bookings b ON b.booking_id = att.booking_id),
firsts AS (SELECT booking_id, request_id FROM (
             SELECT booking_id, request_id, ROW_NUMBER() OVER (PARTITION BY booking_id ORDER BY ts, request_id) AS rn
             FROM a WHERE bid IS NOT NULL AND method IN ('bkash', 'nagad', 'rocket', 'card', 'bank_transfer')) x
           WHERE rn = 1),
r AS (SELECT a.*, CASE WHEN a.bid IS NULL THEN 'booking_not_found'
                       WHEN a.method NOT IN ('bkash', 'nagad', 'rocket', 'card', 'bank_transfer') THEN 'invalid_method'
                       WHEN a.payment_status = 'paid' THEN 'already_paid'
                       WHEN a.booked_ticket_price <= 0 THEN 'invalid_amount'
                       WHEN a.request_id <> f.request_id THEN 'already_paid' END AS reject_reason
      FROM a LEFT JOIN firsts f ON f.booking_id = a.booking_id)"""

_SQL_M2 = _REQ_M2 + r""",
win AS (SELECT request_id, booking_id, ts, method, booked_ticket_price AS amt FROM r WHERE reject_reason IS NULL),
p AS (SELECT payments.*, ROW_NUMBER() OVER (PARTITION BY booking_id ORDER BY paid_at DESC NULLS LAST,
             attempt_no DESC NULLS LAST, acquirer_id DESC NULLS LAST, amount DESC NULLS LAST,
             method DESC NULLS LAST, status DESC NULLS LAST, payment_id DESC) AS rn FROM payments)
SELECT p.payment_id, p.booking_id, p.attempt_no, p.acquirer_id,
       CASE WHEN w.booking_id IS NOT NULL THEN CAST(w.amt AS DECIMAL(10,2)) ELSE p.amount END AS amount,
       CASE WHEN w.booking_id IS NOT NULL THEN w.method ELSE p.method END AS method,
       CASE WHEN w.booking_id IS NOT NULL THEN 'successful' ELSE p.status END AS status,
       CASE WHEN w.booking_id IS NOT NULL THEN w.ts ELSE p.paid_at END AS paid_at
FROM p LEFT JOIN win w ON w.booking_id = p.booking_id AND p.rn = 1
UNION ALL
SELECT (SELECT MAX(payment_id) FROM payments) + 1 + w.request_id, w.booking_id, 1, CAST(NULL AS BIGINT), CAST(w.amt AS DECIMAL(10,2)), w.method, 'initiated', w.ts
FROM win w WHERE NOT EXISTS (SELECT 1 FROM payments p WHERE p.booking_id = w.booking_id)"""


_SQL_M2R = _REQ_M2 + r"""
SELECT request_id, ts, reject_reason FROM r WHERE reject_reason IS NOT NULL"""


_SQL_M4 = r"""
, ds AS (SELECT site_id FROM sites WHERE unesco_status = 'None' AND ticket_price < 905),
de AS (SELECT event_id FROM evts WHERE site_id IN (SELECT site_id FROM ds)),
f AS (SELECT 'bookings' AS table_name, booking_id AS row_id, site_id, event_id FROM bookings
      UNION ALL SELECT 'assignments', assign_id, site_id, event_id FROM assignments
      UNION ALL SELECT 'reviews', review_id, site_id, event_id FROM reviews),
g AS (SELECT f.*, COALESCE(site_id IN (SELECT site_id FROM ds), FALSE) AS hs,
             COALESCE(event_id IN (SELECT event_id FROM de), FALSE) AS he FROM f)
SELECT table_name, row_id, CASE WHEN hs THEN 'site_id' ELSE 'event_id' END AS nulled_column FROM g
WHERE (hs OR he) AND (site_id IS NULL OR hs) AND (event_id IS NULL OR he)"""


_SQL_M10 = r"""
, dom AS (SELECT * FROM (VALUES ('bkash', 'Bkash', 1), ('nagad', 'Nagad', 2), ('rocket', 'Rocket', 3),
                               ('card', 'Card', 4), ('bank_transfer', 'Bank transfer', 5)) d(code, label, position)),
seg AS (SELECT DISTINCT c_mktsegment FROM customer),
prop AS (SELECT 'wallet_' || LOWER(c_mktsegment) AS code, 'Wallet ' || c_mktsegment AS label FROM seg
         UNION ALL SELECT 'Bad Code ' || LOWER(c_mktsegment), 'x' FROM seg),
ok AS (SELECT LOWER(TRIM(code)) AS code, MIN(TRIM(label)) AS label FROM prop
       WHERE regexp_matches(LOWER(TRIM(code)), '^[a-z0-9_\-]{2,40}$')
         AND TRIM(label) <> '' AND LENGTH(TRIM(label)) <= 150
       GROUP BY LOWER(TRIM(code))),
new AS (SELECT code, label FROM ok WHERE code NOT IN (SELECT code FROM dom))
SELECT code, label, position FROM dom
UNION ALL
SELECT code, label, CAST((SELECT MAX(position) FROM dom) + ROW_NUMBER() OVER (ORDER BY code) AS INT) FROM new"""


def _sf(r: Roles) -> str:
    return r.extra["sf_dir"]


@query("M1", "booking_intake", _SQL_M1)
def m1_booking_intake(r: Roles):
    """New bookings created from the booking requests."""
    return intake.booking_intake(r, rq.booking_requests(r.spark, _sf(r))).accepted


@query("M1P", "booking_intake_payments", _REQ_M1 + """,
ok AS (SELECT * FROM chk WHERE reject_reason IS NULL)
SELECT (SELECT MAX(payment_id) FROM payments) + 1 + request_id AS payment_id,
       (SELECT MAX(booking_id) FROM bookings) + ROW_NUMBER() OVER (ORDER BY request_id) AS booking_id, 1 AS attempt_no,
       CAST(NULL AS BIGINT) AS acquirer_id, CAST(COALESCE(sp, ep) * no_of_tickets AS DECIMAL(10,2)) AS amount,
       CASE request_id % 5 WHEN 1 THEN 'nagad' WHEN 2 THEN 'card' WHEN 4 THEN 'rocket' ELSE 'bkash' END AS method,
       'initiated' AS status, ts AS paid_at
FROM ok""")
def m1_new_payments(r: Roles):
    """Payments initiated for the new bookings."""
    return intake.booking_intake(r, rq.booking_requests(r.spark, _sf(r))).extra["payments"]


@query("M1R", "booking_intake_rejects", _SQL_M1R)
def m1_booking_rejects(r: Roles):
    """Rejected booking requests with their reason."""
    return intake.booking_intake(r, rq.booking_requests(r.spark, _sf(r))).rejects


@query("M1V", "booking_intake_new_visitors", _SQL_M1V)
def m1_new_visitors(r: Roles):
    """Guest visitors registered by the booking intake (one per new email)."""
    return intake.booking_intake(r, rq.booking_requests(r.spark, _sf(r))).extra["visitors"]


@query("M2", "payment_settlement", _SQL_M2)
def m2_payment_settlement(r: Roles):
    """Next payments table after settling the payment attempts."""
    return intake.payment_settlement(r, rq.payment_attempts(r.spark, _sf(r))).extra["payments"]


@query("M2B", "payment_settlement_bookings", _REQ_M2 + """
SELECT * REPLACE (CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.booking_id = b.booking_id AND reject_reason IS NULL)
                       THEN 'paid' ELSE payment_status END AS payment_status) FROM bookings b""")
def m2_next_bookings(r: Roles):
    """Next bookings table after settling the payment attempts."""
    return intake.payment_settlement(r, rq.payment_attempts(r.spark, _sf(r))).extra["bookings"]


@query("M2R", "payment_settlement_rejects", _SQL_M2R)
def m2_payment_rejects(r: Roles):
    """Rejected payment attempts with their reason."""
    return intake.payment_settlement(r, rq.payment_attempts(r.spark, _sf(r))).rejects


@query("M4", "delete_cascade_conflicts", _SQL_M4)
def m4_delete_conflicts(r: Roles):
    """XOR conflicts after deleting the cheapest 'None'-status sites and their events (cascade)."""
    gone = r.sites.where((F.col("unesco_status") == "None") & (F.col("ticket_price") < 905)).select("site_id")
    return apply_deletes(r, sites=gone).conflicts


@query("M4B", "delete_cascade_bookings", """
, gone AS (SELECT site_id AS sid FROM sites WHERE unesco_status = 'None' AND ticket_price < 905)
SELECT booking_id, visitor_id, CASE WHEN site_id NOT IN (SELECT sid FROM gone) THEN site_id END AS site_id,
       CASE WHEN event_id NOT IN (SELECT event_id FROM evts JOIN gone ON evts.site_id = sid) THEN event_id END AS event_id,
       booking_date, no_of_tickets, booked_ticket_price, payment_status FROM bookings""")
def m4_bookings_after(r: Roles):
    """Bookings after the deletes of M4: targets that are gone become NULL."""
    gone = r.sites.where((F.col("unesco_status") == "None") & (F.col("ticket_price") < 905)).select("site_id")
    return apply_deletes(r, sites=gone).roles.bookings


def _after_m4(r: Roles):
    """All roles after the deletes of M4 and of every 17th guide and the visitors without a booking from 2000 on."""
    gone = r.sites.where((F.col("unesco_status") == "None") & (F.col("ticket_price") < 905)).select("site_id")
    return apply_deletes(r, sites=gone, guides=r.guides.where("guide_id % 17 = 3").select("guide_id"),
                         bookings=r.bookings.where("booking_id % 8 = 0 OR visitor_id % 50 = 7").select("booking_id"),
                         visitors=r.visitors.where("visitor_id % 50 = 7").select("visitor_id")).roles


_GONE_M4 = """
, ds AS (SELECT site_id AS k FROM sites WHERE unesco_status = 'None' AND ticket_price < 905),
de AS (SELECT event_id AS k FROM evts WHERE site_id IN (SELECT k FROM ds)),
dg AS (SELECT guide_id AS k FROM guides WHERE guide_id % 17 = 3),
db AS (SELECT booking_id AS k FROM bookings WHERE booking_id % 8 = 0 OR visitor_id % 50 = 7),
dv AS (SELECT visitor_id AS k FROM visitors WHERE visitor_id % 50 = 7)
"""
_KEPT = """CASE WHEN site_id NOT IN (SELECT k FROM ds) THEN site_id END AS site_id,
 CASE WHEN event_id NOT IN (SELECT k FROM de) THEN event_id END AS event_id"""


@query("M4S", "delete_cascade_sites", _GONE_M4 + "SELECT * FROM sites WHERE site_id NOT IN (SELECT k FROM ds)")
def m4_sites_after(r: Roles):
    """Sites after the deletes."""
    return _after_m4(r).sites


@query("M4E", "delete_cascade_events", _GONE_M4 + "SELECT * FROM evts WHERE event_id NOT IN (SELECT k FROM de)")
def m4_events_after(r: Roles):
    """Events after the deletes: those of deleted sites go with them."""
    return _after_m4(r).evts


@query("M4V", "delete_restrict_visitors", _GONE_M4 + "SELECT * FROM visitors WHERE visitor_id NOT IN (SELECT k FROM dv)")
def m4_visitors_after(r: Roles):
    """Visitors after the deletes: all their bookings went in the same call, so none is refused."""
    return _after_m4(r).visitors


@query("M4G", "delete_guides", _GONE_M4 + "SELECT * FROM guides WHERE guide_id NOT IN (SELECT k FROM dg)")
def m4_guides_after(r: Roles):
    """Guides after the deletes."""
    return _after_m4(r).guides


@query("M4A", "delete_cascade_assignments", _GONE_M4 + f"""
SELECT assign_id, guide_id, {_KEPT}, shift_time FROM assignments WHERE guide_id NOT IN (SELECT k FROM dg)""")
def m4_assignments_after(r: Roles):
    """Assignments after the deletes: gone with their guide, targets that are gone become NULL."""
    return _after_m4(r).assignments


@query("M4W", "delete_cascade_reviews", _GONE_M4 + f"""
SELECT review_id, visitor_id, {_KEPT}, rating, comment, review_date FROM reviews
WHERE visitor_id NOT IN (SELECT k FROM dv)""")
def m4_reviews_after(r: Roles):
    """Reviews after the deletes: gone with their visitor, targets that are gone become NULL."""
    return _after_m4(r).reviews


@query("M4P", "delete_cascade_payments", _GONE_M4 + "SELECT * FROM payments WHERE booking_id NOT IN (SELECT k FROM db)")
def m4_payments_after(r: Roles):
    """Payments after the deletes: gone with their booking."""
    return _after_m4(r).payments


@query("M4R", "delete_refusals", """
SELECT 'visitors' AS table_name, visitor_id AS key FROM visitors WHERE visitor_id % 3 = 0
INTERSECT SELECT 'visitors', visitor_id FROM bookings WHERE booking_id % 8 <> 0""")
def m4_refusals(r: Roles):
    """Visitors that cannot be deleted, as bookings not deleted with them remain."""
    return apply_deletes(r, visitors=r.visitors.where("visitor_id % 3 = 0").select("visitor_id"),
                         bookings=r.bookings.where("booking_id % 8 = 0").select("booking_id")).refused


@query("M6", "reconciliation", """
, per AS (SELECT booking_id, COUNT(*) FILTER (WHERE status = 'successful') AS ns,
                 CAST(SUM(CASE WHEN status = 'successful' THEN amount END) AS DECIMAL(20,2)) AS success_amount,
                 COUNT(*) FILTER (WHERE status = 'initiated') AS ni FROM payments GROUP BY booking_id),
j AS (SELECT COALESCE(per.booking_id, b.booking_id) AS key, b.booking_id AS bid, b.payment_status,
             b.booked_ticket_price, COALESCE(per.ns, 0) AS ns, per.success_amount, COALESCE(per.ni, 0) AS ni
      FROM per FULL JOIN bookings b ON per.booking_id = b.booking_id)
SELECT 'paid_without_successful_payment' AS finding, key FROM j WHERE bid IS NOT NULL AND payment_status = 'paid' AND ns = 0
UNION ALL SELECT 'payment_without_booking', key FROM j WHERE bid IS NULL
UNION ALL SELECT 'amount_mismatch', key FROM j WHERE bid IS NOT NULL AND ns > 0 AND success_amount <> booked_ticket_price
UNION ALL SELECT 'paid_twice', key FROM j WHERE ns > 1
UNION ALL SELECT 'initiated_but_paid', key FROM j WHERE payment_status = 'paid' AND ns = 0 AND ni > 0
UNION ALL SELECT 'sold_out', e.event_id FROM evts e
  JOIN (SELECT event_id, COUNT(*) AS n FROM bookings WHERE event_id IS NOT NULL GROUP BY event_id) c
  ON c.event_id = e.event_id WHERE e.capacity > 0 AND c.n > e.capacity""")
def m6_reconciliation(r: Roles):
    """Reconciliation findings over bookings, payments and capacity."""
    return reconciliation(r)


@query("M7", "review_intake", _SQL_M7)
def m7_review_intake(r: Roles):
    """New reviews from review requests (clamped ratings, one target)."""
    return intake.review_intake(r, rq.review_requests(r.spark, _sf(r))).accepted


@query("M7R", "review_intake_rejects", _SQL_M7[:_SQL_M7.index(",\nok AS")] + """
SELECT request_id, ts, CASE WHEN site_id IS NULL THEN 'no_target' ELSE 'both_targets' END AS reject_reason
FROM req WHERE (site_id IS NULL) = (event_id IS NULL)""")
def m7_review_rejects(r: Roles):
    """Rejected review requests with their reason."""
    return intake.review_intake(r, rq.review_requests(r.spark, _sf(r))).rejects


@query("M8", "visitor_registration", _SQL_M8)
def m8_visitor_registration(r: Roles):
    """New visitors from sign-up requests (unique lower-cased email, first wins)."""
    return intake.visitor_registration(r, rq.signup_requests(r.spark, _sf(r))).accepted


@query("M8A", "visitor_registration_admin", _REQ_M8.replace(
    "ELSE ' ' || c_name END) AS full_name", "WHEN c_custkey % 31 = 0 THEN c_name || REPEAT(' the Long-Named', 10) "
    "ELSE ' ' || c_name END) AS full_name") + r"""SELECT (SELECT MAX(visitor_id) FROM visitors) + ROW_NUMBER() OVER (ORDER BY request_id) AS visitor_id,
       LEFT(full_name, 120) AS full_name, nationality, email, CAST(ts AS DATE) AS created_at, '0180000000' AS phone
FROM ranked WHERE base IS NULL AND rn = 1""")
def m8_admin_registration(r: Roles):
    """New visitors of the admin form, which cuts names to the column's width."""
    q = rq.signup_requests(r.spark, _sf(r))
    long = F.col("full_name").isNotNull() & (F.trim("full_name") != "") & (F.col("request_id") % 31 == 0)
    q = q.withColumn("full_name", F.when(long, F.concat(F.trim("full_name"), F.repeat(F.lit(" the Long-Named"), 10)))
                     .otherwise(F.col("full_name")))
    return intake.visitor_registration(r, q, admin=True).accepted


@query("M8R", "visitor_registration_rejects", _SQL_M8R)
def m8_visitor_rejects(r: Roles):
    """Rejected sign-ups with their reason."""
    return intake.visitor_registration(r, rq.signup_requests(r.spark, _sf(r))).rejects


@query("M9", "contact_intake", _SQL_M9)
def m9_contact_intake(r: Roles):
    """Accepted contact messages."""
    return intake.contact_intake(rq.contact_requests(r.spark, _sf(r))).accepted


@query("M10", "method_domain_growth", _SQL_M10)
def m10_method_domain_growth(r: Roles):
    """Payment-method domain after adding the valid proposals."""
    return intake.method_domain_growth(intake.method_domain(r.spark), rq.method_requests(r.spark, _sf(r))).accepted


@query("T3", "daily_bookings_revenue", """
SELECT date_trunc('day', booking_date) AS window_start, date_trunc('day', booking_date) + INTERVAL 1 DAY AS window_end,
       COUNT(*) AS bookings, CAST(SUM(booked_ticket_price) AS DECIMAL(20,2)) AS revenue
FROM bookings GROUP BY 1, 2""")
def t3_daily_bookings_revenue(r: Roles):
    """Batch core of the T3 stream: bookings and revenue per tumbling day."""
    return daily_totals(r.bookings)


# ---------------------------------------------------------------- M3 through the snapshot pointer

_SQL_M3 = r"""
, chg AS (
  SELECT p_partkey AS site_id, 'upsert' AS op, 1 AS day, p_name AS name, CAST(1 AS DECIMAL(10,2)) AS ticket_price,
         'overridden' AS description, p_brand, p_type FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, 'upsert', 2, UPPER(p_name), CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 1.25 AS DECIMAL(10,2)),
         NULL, p_brand, p_type FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'delete', 3, NULL, NULL, NULL, p_brand, p_type FROM part WHERE p_partkey % 12 = 0
  UNION ALL SELECT p_partkey + (SELECT MAX(p_partkey) FROM part) + 1, 'upsert', 4, 'new ' || p_name,
         CAST(p_retailprice AS DECIMAL(10,2)), 'new', p_brand, p_type FROM part WHERE p_partkey % 10 = 1),
last AS (SELECT * FROM chg QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY day DESC) = 1)
SELECT * FROM sites WHERE site_id NOT IN (SELECT site_id FROM last)
UNION ALL
SELECT l.site_id, l.name, l.p_brand, l.p_type, l.ticket_price, 'Tentative', COALESCE(l.description, s.description),
       DATE '2002-01-01', s.opening_hours FROM last l LEFT JOIN sites s ON s.site_id = l.site_id WHERE l.op = 'upsert'"""


@query("M3", "upsert_sites", _SQL_M3)
def m3_upsert_sites(r: Roles):
    """Sites after a batch of keyed changes, read through the table's snapshot pointer."""
    table = SnapshotTable(r.spark, f"{checkpoint_dir(r.spark)}/sites-{uuid.uuid4().hex}")
    table.commit(r.sites, None)
    changes = rq.site_changes(r.spark, _sf(r))
    table.update(lambda sites: upsert(sites, changes, ["site_id"], keep_old=["description", "opening_hours"]))
    return table.read()


# ---------------------------------------------------------------- T1, T2, T4 replayed in two micro-batches

def _halves(requests):
    """By request id: the first half of the range, then the rest."""
    middle = requests.select(((F.min("request_id") + F.max("request_id")) / 2).cast("bigint")).scalar()
    return [F.col("request_id") <= middle, F.col("request_id") > middle]


def _booking_stream(r: Roles) -> str:
    requests = rq.booking_requests(r.spark, _sf(r))
    return replay(requests, BOOKING_REQUEST_SCHEMA, _halves(requests),
                  lambda source, sink, ck: start_booking_stream(r.spark, r, source, sink, ck, dedupe_delay=None))


def _payment_stream(r: Roles) -> str:
    attempts = rq.payment_attempts(r.spark, _sf(r))
    return replay(attempts, PAYMENT_ATTEMPT_SCHEMA, _halves(attempts),
                  lambda source, sink, ck: start_payment_stream(r.spark, r, source, sink, ck, dedupe_delay=None))


# The stream's new visitors take the table's maximum + 1 + the registering request's id.
_GUESTS_T1 = _GUESTS_M1.replace("(SELECT MAX(visitor_id) FROM visitors) + ROW_NUMBER() OVER (ORDER BY first_req)",
                                "(SELECT MAX(visitor_id) FROM visitors) + 1 + first_req")


@query("T1", "booking_stream", _SQL_M1.replace(_GUESTS_M1, _GUESTS_T1))
def t1_booking_stream(r: Roles):
    """Bookings of the request stream: two micro-batches, guests matched by keyed state."""
    return r.spark.read.parquet(f"{_booking_stream(r)}/bookings").drop("batch_id")


@query("T1V", "booking_stream_new_visitors", _SQL_M1V.replace(_GUESTS_M1, _GUESTS_T1))
def t1_new_visitors(r: Roles):
    """Visitors that the request stream registers, once per e-mail over all micro-batches."""
    return r.spark.read.parquet(f"{_booking_stream(r)}/visitors").drop("batch_id")


@query("T2", "payment_stream_changes", _REQ_M2 + """,
latest AS (SELECT * FROM payments QUALIFY ROW_NUMBER() OVER (PARTITION BY booking_id ORDER BY paid_at DESC NULLS LAST,
             attempt_no DESC NULLS LAST, acquirer_id DESC NULLS LAST, amount DESC NULLS LAST, method DESC NULLS LAST,
             status DESC NULLS LAST, payment_id DESC) = 1)
SELECT COALESCE(p.payment_id, (SELECT MAX(payment_id) FROM payments) + 1 + r.request_id) AS payment_id, r.booking_id, CASE WHEN p.booking_id IS NULL THEN 'insert' ELSE 'update' END AS change,
       CAST(COALESCE(p.attempt_no, 1) AS BIGINT) AS attempt_no, p.acquirer_id, r.booked_ticket_price AS amount, r.method,
       CASE WHEN p.booking_id IS NULL THEN 'initiated' ELSE 'successful' END AS status, r.ts AS paid_at
FROM r LEFT JOIN latest p ON p.booking_id = r.booking_id WHERE r.reject_reason IS NULL""")
def t2_payment_stream(r: Roles):
    """Payments that the attempt stream settles or inserts, over two micro-batches."""
    return r.spark.read.parquet(f"{_payment_stream(r)}/payment_changes").drop("batch_id")


@query("T2R", "payment_stream_rejects", _SQL_M2R)
def t2_payment_rejects(r: Roles):
    """Attempts that the stream rejects, also those that an earlier micro-batch has settled."""
    return r.spark.read.parquet(f"{_payment_stream(r)}/rejects").drop("batch_id")


@query("T4", "dedupe_requests", "SELECT DISTINCT o_orderkey AS request_id, o_custkey FROM orders")
def t4_dedupe_requests(r: Roles):
    """Requests left when retries are dropped within the watermark, also across micro-batches."""
    requests = rq.retried_requests(r.spark, _sf(r))
    # Five minutes after a day's requests: their retries fall into the second micro-batch.
    cut = requests.select((F.timestamp_seconds((F.min(F.unix_seconds(F.col("ts").cast("timestamp"))) + F.max(
        F.unix_seconds(F.col("ts").cast("timestamp")))) / 2)).alias("m")).select(
        (F.date_trunc("day", "m") + F.expr("INTERVAL 5 MINUTES")).alias("m")).scalar()

    def start(source, sink, ck):
        stream = dedupe_requests(r.spark.readStream.schema(BOOKING_REQUEST_SCHEMA).parquet(source))
        return (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck)
                .trigger(availableNow=True).start())
    ts = F.col("ts")
    kept = r.spark.read.parquet(replay(requests, BOOKING_REQUEST_SCHEMA, [ts < cut, ts >= cut], start))
    orders = r.bookings.select("booking_id", F.col("visitor_id").alias("o_custkey"))
    return kept.join(orders, F.col("request_id") == F.col("booking_id")).select("request_id", "o_custkey")


@query("T3M", "month_rollup", """
SELECT CAST(date_trunc('month', booking_date) AS DATE) AS month, COUNT(*) AS bookings,
       CAST(SUM(booked_ticket_price) AS DECIMAL(20,2)) AS revenue FROM bookings GROUP BY 1""")
def t3_month_rollup(r: Roles):
    """Month totals kept from daily totals: the early days first, then all days, of which only the new ones count."""
    table = SnapshotTable(r.spark, f"{checkpoint_dir(r.spark)}/months-{uuid.uuid4().hex}")
    days = daily_totals(r.bookings)
    merge_days(table, days.where(F.col("window_start") < F.lit("1998-03-10").cast("timestamp")))
    merge_days(table, days)
    return table.read().select("month", "bookings", "revenue")
