"""Data-quality reports: X2 constraint report over all role tables, X3 domain reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators.checks import Rule, domain_report, orphans, violations, xor_target_rule
from sitelens.plans.people import PAYMENT_METHODS, PAYMENT_STATUSES
from sitelens.plans.registry import query
from sitelens.sources.roles import Roles

_X2_SQL = """
SELECT 'sites' AS table_name, 'negative_price' AS rule, site_id AS row_id FROM sites WHERE ticket_price < 0
UNION ALL SELECT 'evts', 'capacity_not_positive', event_id FROM evts WHERE capacity <= 0
UNION ALL SELECT 'evts', 'fk_site_id', e.event_id FROM evts e WHERE e.site_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM sites s WHERE s.site_id = e.site_id)
UNION ALL SELECT 'visitors', 'duplicate_email', v.visitor_id FROM visitors v
  WHERE lower(v.email) IN (SELECT lower(email) FROM visitors GROUP BY lower(email) HAVING COUNT(*) > 1)
UNION ALL SELECT 'bookings', 'both_targets', booking_id FROM bookings WHERE site_id IS NOT NULL AND event_id IS NOT NULL
UNION ALL SELECT 'bookings', 'no_target', booking_id FROM bookings WHERE site_id IS NULL AND event_id IS NULL
UNION ALL SELECT 'bookings', 'tickets_below_one', booking_id FROM bookings WHERE no_of_tickets < 1
UNION ALL SELECT 'bookings', 'fk_visitor_id', b.booking_id FROM bookings b WHERE b.visitor_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM visitors v WHERE v.visitor_id = b.visitor_id)
UNION ALL SELECT 'bookings', 'fk_site_id', b.booking_id FROM bookings b WHERE b.site_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM sites s WHERE s.site_id = b.site_id)
UNION ALL SELECT 'bookings', 'fk_event_id', b.booking_id FROM bookings b WHERE b.event_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM evts e WHERE e.event_id = b.event_id)
UNION ALL SELECT 'payments', 'amount_not_positive', booking_id FROM payments WHERE amount <= 0
UNION ALL SELECT 'payments', 'method_outside_domain', booking_id FROM payments
  WHERE method NOT IN ('bkash', 'nagad', 'rocket', 'card', 'bank_transfer')
UNION ALL SELECT 'payments', 'status_outside_domain', booking_id FROM payments
  WHERE status NOT IN ('initiated', 'successful', 'failed', 'refunded')
UNION ALL SELECT 'payments', 'fk_booking_id', p.booking_id FROM payments p WHERE p.booking_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM bookings b WHERE b.booking_id = p.booking_id)
UNION ALL SELECT 'guides', 'negative_salary', guide_id FROM guides WHERE salary < 0
UNION ALL SELECT 'assignments', 'both_targets', assign_id FROM assignments WHERE site_id IS NOT NULL AND event_id IS NOT NULL
UNION ALL SELECT 'assignments', 'no_target', assign_id FROM assignments WHERE site_id IS NULL AND event_id IS NULL
UNION ALL SELECT 'assignments', 'fk_guide_id', a.assign_id FROM assignments a WHERE a.guide_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM guides g WHERE g.guide_id = a.guide_id)
UNION ALL SELECT 'reviews', 'both_targets', review_id FROM reviews WHERE site_id IS NOT NULL AND event_id IS NOT NULL
UNION ALL SELECT 'reviews', 'no_target', review_id FROM reviews WHERE site_id IS NULL AND event_id IS NULL
UNION ALL SELECT 'reviews', 'rating_out_of_range', review_id FROM reviews WHERE rating < 1 OR rating > 5
UNION ALL SELECT 'reviews', 'fk_visitor_id', r.review_id FROM reviews r WHERE r.visitor_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM visitors v WHERE v.visitor_id = r.visitor_id)"""


def _tag(df, table: str, rule: str, key: str):
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col(key).alias("row_id"))


@query("X2R", "constraint_report", _X2_SQL)
def constraint_report(r: Roles):
    """Every declared constraint of the model checked at once: row rules, uniqueness, FK orphans.

    Row rules of one table are evaluated in a single scan (``violations``);
    uniqueness is a grouped count; foreign keys are anti joins.
    """
    def rowrules(df, table, key, rules):
        return violations(df, rules, [key]).select(F.lit(table).alias("table_name"), "rule",
                                                   F.col(key).alias("row_id"))

    parts = [
        rowrules(r.sites, "sites", "site_id", [Rule("negative_price", F.col("ticket_price") < 0)]),
        rowrules(r.evts, "evts", "event_id", [Rule("capacity_not_positive", F.col("capacity") <= 0)]),
        _tag(orphans(r.evts, "site_id", r.sites, "site_id"), "evts", "fk_site_id", "event_id"),
        rowrules(r.bookings, "bookings", "booking_id",
                 xor_target_rule() + [Rule("tickets_below_one", F.col("no_of_tickets") < 1)]),
        _tag(orphans(r.bookings, "visitor_id", r.visitors, "visitor_id"), "bookings", "fk_visitor_id", "booking_id"),
        _tag(orphans(r.bookings, "site_id", r.sites, "site_id"), "bookings", "fk_site_id", "booking_id"),
        _tag(orphans(r.bookings, "event_id", r.evts, "event_id"), "bookings", "fk_event_id", "booking_id"),
        rowrules(r.payments, "payments", "booking_id",
                 [Rule("amount_not_positive", F.col("amount") <= 0),
                  Rule("method_outside_domain", ~F.col("method").isin(*PAYMENT_METHODS)),
                  Rule("status_outside_domain", ~F.col("status").isin(*PAYMENT_STATUSES))]),
        _tag(orphans(r.payments, "booking_id", r.bookings, "booking_id"), "payments", "fk_booking_id", "booking_id"),
        rowrules(r.guides, "guides", "guide_id", [Rule("negative_salary", F.col("salary") < 0)]),
        rowrules(r.assignments, "assignments", "assign_id", xor_target_rule()),
        _tag(orphans(r.assignments, "guide_id", r.guides, "guide_id"), "assignments", "fk_guide_id", "assign_id"),
        rowrules(r.reviews, "reviews", "review_id",
                 xor_target_rule() + [Rule("rating_out_of_range", (F.col("rating") < 1) | (F.col("rating") > 5))]),
        _tag(orphans(r.reviews, "visitor_id", r.visitors, "visitor_id"), "reviews", "fk_visitor_id", "review_id"),
    ]
    dup = (r.visitors.groupBy(F.lower("email").alias("__e")).agg(F.count(F.lit(1)).alias("__n"))
           .where(F.col("__n") > 1))
    dup_rows = r.visitors.join(dup, F.lower(F.col("email")) == F.col("__e"), "left_semi")
    parts.insert(3, _tag(dup_rows, "visitors", "duplicate_email", "visitor_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("X3S", "status_domain", """
SELECT COALESCE(o.value, d.value) AS value, COALESCE(o.rows, 0) AS rows,
       d.pos IS NOT NULL AS declared, d.pos AS declared_position
FROM (SELECT status AS value, COUNT(*) AS rows FROM payments GROUP BY status) o
FULL JOIN (VALUES ('initiated', 1), ('successful', 2), ('failed', 3), ('refunded', 4)) d(value, pos)
  ON o.value = d.value""")
def status_domain(r: Roles):
    """Observed payment statuses against the declared status domain."""
    return domain_report(r.payments, "status", PAYMENT_STATUSES)
