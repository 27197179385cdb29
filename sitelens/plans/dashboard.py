"""Dashboard KPIs, chart series, API series and page queries D01..D34.

Pages that ask for one site, booking or visitor are built in bulk form (every
key in one job); pass a key to filter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sitelens.functions import (avg_exact, avg_int, day_lit, month_bucket, ravg, ravg_int, sum2,
                                ts_lit)
from sitelens.operators.aggs import avg_of_avgs, branch_aggregate, group_count, per_key
from sitelens.operators.joins import anti, bounded, bounded_lookup, lookup, not_in, resolve_target, semi, target_names
from sitelens.operators.sets import union_distinct
from sitelens.operators.windows import latest_per_key, top_k_per_group
from sitelens.plans.explorer import SUCCESS, bookings_per_site
from sitelens.plans.registry import query
from sitelens.plans.sqlfrag import s_avg, s_ravg, s_ravgi, s_sum
from sitelens.sources.roles import Roles


def _zero2():
    return F.lit(0).cast("decimal(20,2)")


def _count(df, alias):
    return df.select(F.count(F.lit(1)).alias(alias))


@query("D01", "totals", """
SELECT (SELECT COUNT(*) FROM sites) AS total_sites, (SELECT COUNT(*) FROM bookings) AS total_bookings""")
def totals(r: Roles):
    """Total sites and total bookings (one row)."""
    return _count(r.sites, "total_sites").withColumn("total_bookings", _count(r.bookings, "n").scalar())


@query("D02", "distinct_booking_visitors", """
SELECT COUNT(DISTINCT visitor_id) AS total_visitors FROM bookings""")
def distinct_booking_visitors(r: Roles):
    """Distinct visitors with bookings."""
    return r.bookings.select(F.count_distinct("visitor_id").alias("total_visitors"))


@query("D03", "overall_avg_rating", """
SELECT COALESCE(CAST(ROUND(CAST(AVG(avg_rating) AS DECIMAL(18,8)), 2) AS DECIMAL(14,2)), 0) AS avg_rating_overall
FROM (SELECT CAST(AVG(rating) AS DECIMAL(14,4)) AS avg_rating FROM reviews GROUP BY site_id) t""")
def overall_avg_rating(r: Roles, drop_null_group: bool = False):
    """Average of per-site average ratings; the NULL site (event reviews) is a group too."""
    a = avg_of_avgs(r.reviews, "site_id", avg_int("rating"), drop_null_group)
    return a.select(F.coalesce(F.round("avg_of_avgs", 2).cast("decimal(14,2)"),
                               F.lit(0).cast("decimal(14,2)")).alias("avg_rating_overall"))


@query("D04", "avg_booked_price", f"""
SELECT COALESCE({s_ravg('booked_ticket_price')}, 0) AS avg_ticket_price FROM bookings WHERE booked_ticket_price > 0""")
def avg_booked_price(r: Roles):
    """ROUND(AVG(booked price), 2) over priced bookings, 0 when none."""
    return (r.bookings.where(F.col("booked_ticket_price") > 0)
            .select(F.coalesce(ravg("booked_ticket_price"), F.lit(0).cast("decimal(14,2)")).alias("avg_ticket_price")))


@query("D05", "total_revenue", f"""
SELECT COALESCE({s_sum('amount')}, 0) AS total_revenue FROM payments WHERE status IN ('successful', 'success')""")
def total_revenue(r: Roles, statuses=(SUCCESS,)):
    """Total successful revenue, 0 when none."""
    return (r.payments.where(F.col("status").isin(*statuses))
            .select(F.coalesce(sum2("amount"), _zero2()).alias("total_revenue")))


@query("D06", "total_by_method", f"""
SELECT method, {s_sum('amount')} AS total FROM payments GROUP BY method ORDER BY total DESC""")
def total_by_method(r: Roles):
    """Amount per method over all statuses."""
    return r.payments.groupBy("method").agg(sum2("amount").alias("total")).orderBy(F.desc("total"))


@query("D07", "avg_guide_salary", f"""SELECT {s_ravg('salary')} AS avg_salary FROM guides""")
def avg_guide_salary(r: Roles):
    """ROUND(AVG(salary), 2)."""
    return r.guides.select(ravg("salary").alias("avg_salary"))


@query("D08", "unassigned_guides", """
SELECT full_name FROM guides LEFT JOIN assignments ON guides.guide_id = assignments.guide_id
WHERE assignments.guide_id IS NULL""")
def unassigned_guides(r: Roles):
    """Guides without assignments (LEFT JOIN … IS NULL → anti join)."""
    return anti(r.guides, r.assignments, "guide_id", right_key="guide_id").select("full_name")


@query("D09", "top_site_names_by_bookings", """
SELECT h.name, COUNT(b.booking_id) AS total_bookings FROM sites h JOIN bookings b ON h.site_id = b.site_id
GROUP BY h.name ORDER BY total_bookings DESC, h.name LIMIT 3""")
def top_site_names_by_bookings(r: Roles, k: int = 3):
    """Top k site *names* by bookings (same-named sites merge, unbooked sites drop out)."""
    per = per_key(r.bookings, "site_id", [F.count(F.lit(1)).alias("__n")])
    return (per.join(r.sites.select("site_id", "name"), "site_id").groupBy("name")
            .agg(F.sum("__n").alias("total_bookings")).orderBy(F.desc("total_bookings"), "name").limit(k))


@query("D10", "latest_site_reviews", """
SELECT v.full_name AS visitor, s.name AS site, r.rating, r.comment FROM reviews r
JOIN visitors v ON r.visitor_id = v.visitor_id JOIN sites s ON r.site_id = s.site_id
ORDER BY r.review_id DESC LIMIT 5""")
def latest_site_reviews(r: Roles, k: int = 5):
    """Latest k reviews of sites (event reviews drop out of the inner join)."""
    rv = semi(semi(r.reviews, r.visitors, "visitor_id", right_key="visitor_id"), r.sites, "site_id",
              right_key="site_id")
    top = rv.orderBy(F.desc("review_id")).limit(k)
    j = (bounded(top, k).join(r.visitors.select("visitor_id", F.col("full_name").alias("visitor")), "visitor_id"))
    j = bounded(j, k).join(r.sites.select("site_id", F.col("name").alias("site")), "site_id")
    return j.orderBy(F.desc("review_id")).select("visitor", "site", "rating", "comment")


@query("D11A", "sites_with_events", """SELECT name FROM sites WHERE site_id IN (SELECT site_id FROM evts)""")
def sites_with_events(r: Roles):
    """Names of sites with events (IN)."""
    return semi(r.sites, r.evts, "site_id", right_key="site_id").select("name")


@query("D11B", "bookings_with_payments_sample", """
SELECT b.booking_id, v.full_name, p.method, p.amount, p.status FROM bookings b
JOIN visitors v ON b.visitor_id = v.visitor_id JOIN payments p ON b.booking_id = p.booking_id
ORDER BY b.booking_id, p.attempt_no, p.acquirer_id, p.amount, p.method, p.status LIMIT 5""")
def bookings_with_payments_sample(r: Roles, k: int = 5):
    """First k (booking, payment) rows with visitor name."""
    b = semi(r.bookings.select("booking_id", "visitor_id"), r.visitors, "visitor_id", right_key="visitor_id")
    tie = ["booking_id", "attempt_no", "acquirer_id", "amount", "method", "status"]
    top = b.join(r.payments.select(*tie), "booking_id").orderBy(*tie).limit(k)
    return (bounded(top, k).join(r.visitors.select("visitor_id", "full_name"), "visitor_id")
            .orderBy(*tie).select("booking_id", "full_name", "method", "amount", "status"))


@query("D11C", "guides_without_site", """
SELECT full_name FROM guides WHERE guide_id NOT IN (SELECT guide_id FROM assignments)""")
def guides_without_site(r: Roles):
    """Guides not in assignments (NOT IN)."""
    return not_in(r.guides, "guide_id", r.assignments, "guide_id").select("full_name")


@query("D11D", "booked_not_reviewed_visitors", """
SELECT full_name FROM visitors WHERE visitor_id IN (SELECT visitor_id FROM bookings)
AND visitor_id NOT IN (SELECT visitor_id FROM reviews)""")
def booked_not_reviewed_visitors(r: Roles):
    """Visitors who booked but never reviewed (IN + NOT IN)."""
    v = semi(r.visitors, r.bookings, "visitor_id", right_key="visitor_id")
    return not_in(v, "visitor_id", r.reviews, "visitor_id").select("full_name")


@query("D11E", "sites_with_bookings_or_reviews", """
SELECT site_id, name FROM sites WHERE site_id IN (SELECT site_id FROM bookings)
UNION SELECT site_id, name FROM sites WHERE site_id IN (SELECT site_id FROM reviews)""")
def sites_with_bookings_or_reviews(r: Roles):
    """UNION of booked sites and reviewed sites."""
    s = r.sites.select("site_id", "name")
    return union_distinct(semi(s, r.bookings, "site_id", right_key="site_id"),
                          semi(s, r.reviews, "site_id", right_key="site_id"))


@query("D12", "revenue_by_method", f"""
SELECT method, COALESCE({s_sum('amount')}, 0) AS total FROM payments WHERE status IN ('successful', 'success')
GROUP BY method ORDER BY total DESC""")
def revenue_by_method(r: Roles, method: str | None = None, statuses=(SUCCESS,)):
    """Successful revenue per method, optionally for one method."""
    p = r.payments.where(F.col("status").isin(*statuses))
    if method:
        p = p.where(F.col("method") == method)
    return p.groupBy("method").agg(F.coalesce(sum2("amount"), _zero2()).alias("total")).orderBy(F.desc("total"))


def _range_start(as_of: dt.date, range_: str):
    """Lower bound and comparison for the 3m/6m/12m/ytd chart ranges."""
    if range_ == "ytd":
        return ts_lit(dt.date(as_of.year, 1, 1)), True
    months = {"3m": 3, "6m": 6, "12m": 12}[range_]
    return F.add_months(day_lit(as_of), -months).cast("timestamp_ntz"), False


@query("D13", "bookings_by_month", """
SELECT strftime(booking_date, '%Y-%m') AS ym, COUNT(*) AS cnt FROM bookings
WHERE booking_date > TIMESTAMP '2001-02-01 00:00:00' GROUP BY ym ORDER BY ym""")
def bookings_by_month(r: Roles, range_: str = "6m"):
    """Bookings per month in the chosen range (months: strict '>', ytd: '>=' Jan 1)."""
    start, inclusive = _range_start(r.as_of_sales, range_)
    cond = F.col("booking_date") >= start if inclusive else F.col("booking_date") > start
    return group_count(r.bookings.where(cond), month_bucket("booking_date").alias("ym")).orderBy("ym")


@query("D13Y", "bookings_by_month_ytd", """
SELECT strftime(booking_date, '%Y-%m') AS ym, COUNT(*) AS cnt FROM bookings
WHERE booking_date >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY ym ORDER BY ym""")
def bookings_by_month_ytd(r: Roles):
    """Year-to-date form of D13."""
    return bookings_by_month(r, "ytd")


@query("D14", "monthly_revenue_12m", f"""
SELECT strftime(paid_at, '%Y-%m') AS ym, COALESCE({s_sum('amount')}, 0) AS revenue FROM payments
WHERE status IN ('successful', 'success') AND paid_at > TIMESTAMP '2000-08-01 00:00:00' GROUP BY ym ORDER BY ym""")
def monthly_revenue_12m(r: Roles, months: int = 12, statuses=(SUCCESS,)):
    """Successful revenue per month over the last n months."""
    start = F.add_months(day_lit(r.as_of_sales), -months).cast("timestamp_ntz")
    p = r.payments.where(F.col("status").isin(*statuses) & (F.col("paid_at") > start))
    return (p.groupBy(month_bucket("paid_at").alias("ym")).agg(F.coalesce(sum2("amount"), _zero2()).alias("revenue"))
            .orderBy("ym"))


@query("D15", "payment_status_distribution", """SELECT status, COUNT(*) AS cnt FROM payments GROUP BY status""")
def payment_status_distribution(r: Roles):
    """Payments per status."""
    return group_count(r.payments, "status")


@query("D16", "top10_sites_by_bookings", """
SELECT hs.site_id, hs.name, COUNT(b.booking_id) AS bookings_count FROM sites hs
LEFT JOIN bookings b ON hs.site_id = b.site_id GROUP BY hs.site_id, hs.name
ORDER BY bookings_count DESC, hs.site_id LIMIT 10""")
def top10_sites_by_bookings(r: Roles, k: int = 10):
    """Top k sites by bookings, by id, zero kept."""
    return bookings_per_site(r, "bookings_count").orderBy(F.desc("bookings_count"), "site_id").limit(k)


@query("D17", "top_site_ratings", f"""
SELECT hs.site_id, hs.name, {s_ravgi('r.rating', 1)} AS avg_rating, COUNT(r.review_id) AS reviews_count
FROM sites hs LEFT JOIN reviews r ON hs.site_id = r.site_id GROUP BY hs.site_id, hs.name
HAVING COUNT(r.review_id) > 0 ORDER BY avg_rating DESC, hs.site_id LIMIT 10""")
def top_site_ratings(r: Roles, k: int = 10):
    """Top k sites by ROUND(AVG(rating), 1) among reviewed sites."""
    per = per_key(r.reviews, "site_id", [ravg_int("rating", 1).alias("avg_rating"),
                                         F.count("review_id").alias("reviews_count")])
    return (r.sites.select("site_id", "name").join(per.where(F.col("reviews_count") > 0), "site_id")
            .orderBy(F.desc("avg_rating"), "site_id").limit(k))


@query("D18", "guide_workload", """
SELECT g.guide_id, g.full_name AS name, g.language, g.specialization, g.salary,
       COUNT(a.assign_id) AS assignments_count FROM guides g LEFT JOIN assignments a ON g.guide_id = a.guide_id
GROUP BY g.guide_id, g.full_name, g.language, g.specialization, g.salary
ORDER BY assignments_count DESC, g.guide_id LIMIT 20""")
def guide_workload(r: Roles, guide_id: int | None = None, k: int = 20):
    """Assignments per guide, optionally for one guide; top k."""
    g = r.guides if guide_id is None else r.guides.where(F.col("guide_id") == guide_id)
    per = per_key(r.assignments, "guide_id", [F.count("assign_id").alias("assignments_count")])
    return (g.join(per, "guide_id", "left").fillna({"assignments_count": 0})
            .select("guide_id", F.col("full_name").alias("name"), "language", "specialization", "salary",
                    "assignments_count")
            .orderBy(F.desc("assignments_count"), "guide_id").limit(k))


@query("D19", "recent_reviews_filtered", """
SELECT r.review_id, v.full_name AS visitor, COALESCE(hs.name, '—') AS site, r.rating, r.comment, r.review_date
FROM reviews r JOIN visitors v ON r.visitor_id = v.visitor_id LEFT JOIN sites hs ON r.site_id = hs.site_id
ORDER BY r.review_id DESC LIMIT 10""")
def recent_reviews_filtered(r: Roles, site_id: int | None = None, date: str | None = None, k: int = 10):
    """Latest k reviews, optionally for one site and/or one date; '—' for event reviews."""
    rv = semi(r.reviews, r.visitors, "visitor_id", right_key="visitor_id")
    if site_id is not None:
        rv = rv.where(F.col("site_id") == site_id)
    if date:
        rv = rv.where(F.col("review_date") == day_lit(date))
    top = rv.orderBy(F.desc("review_id")).limit(k)
    j = (bounded(top, k).join(r.visitors.select("visitor_id", F.col("full_name").alias("visitor")), "visitor_id")
         .transform(lambda d: bounded_lookup(d, k, r.sites, "site_id", "site_id", {"name": "__s"})))
    return (j.orderBy(F.desc("review_id"))
            .select("review_id", "visitor", F.coalesce("__s", F.lit("—")).alias("site"), "rating", "comment",
                    "review_date"))


@query("D20", "bookings_by_nationality_top8", """
SELECT COALESCE(v.nationality, 'Unknown') AS nationality, COUNT(b.booking_id) AS cnt FROM bookings b
JOIN visitors v ON b.visitor_id = v.visitor_id GROUP BY v.nationality ORDER BY cnt DESC, 1 LIMIT 8""")
def bookings_by_nationality_top8(r: Roles, k: int = 8):
    """Top k nationalities by bookings ('Unknown' label for NULL)."""
    per_v = per_key(r.bookings, "visitor_id", [F.count(F.lit(1)).alias("__n")])
    g = (per_v.join(r.visitors.select("visitor_id", "nationality"), "visitor_id").groupBy("nationality")
         .agg(F.sum("__n").alias("cnt")))
    return (g.select(F.coalesce("nationality", F.lit("Unknown")).alias("nationality"), "cnt")
            .orderBy(F.desc("cnt"), "nationality").limit(k))


@query("D21A", "api_bookings_per_month", """
SELECT strftime(booking_date, '%Y-%m') AS ym, COUNT(*) AS cnt FROM bookings GROUP BY ym ORDER BY ym""")
def api_bookings_per_month(r: Roles):
    """API series: bookings per month, all time."""
    return group_count(r.bookings, month_bucket("booking_date").alias("ym")).orderBy("ym")


@query("D21B", "api_revenue_by_method", f"""
SELECT method, {s_sum('amount')} AS total FROM payments WHERE status = 'successful' GROUP BY method""")
def api_revenue_by_method(r: Roles, statuses=(SUCCESS,)):
    """API series: successful revenue per method (the status literal drift is fixed)."""
    return r.payments.where(F.col("status").isin(*statuses)).groupBy("method").agg(sum2("amount").alias("total"))


@query("D21C", "api_guide_workload", """
SELECT g.full_name, COUNT(a.assign_id) AS assignments FROM guides g LEFT JOIN assignments a
ON g.guide_id = a.guide_id GROUP BY g.guide_id, g.full_name""")
def api_guide_workload(r: Roles):
    """API series: assignments per guide."""
    per = per_key(r.assignments, "guide_id", [F.count("assign_id").alias("assignments")])
    return (r.guides.select("guide_id", "full_name").join(per, "guide_id", "left").fillna({"assignments": 0})
            .select("full_name", "assignments"))


@query("D21D", "api_review_distribution", """
SELECT rating, COUNT(*) AS cnt FROM reviews GROUP BY rating ORDER BY rating""")
def api_review_distribution(r: Roles):
    """API series: reviews per rating."""
    return group_count(r.reviews, "rating").orderBy("rating")


@query("D21E", "api_payment_status", """SELECT status, COUNT(*) AS cnt FROM payments GROUP BY status""")
def api_payment_status(r: Roles):
    """API series: payments per status."""
    return group_count(r.payments, "status")


@query("D22", "site_events_availability", """
SELECT e.event_id, e.site_id, e.name, e.event_date, e.event_time, e.ticket_price, e.capacity,
       COALESCE(c.n, 0) AS booked_tickets,
       CASE WHEN e.capacity > 0 THEN GREATEST(0, e.capacity - COALESCE(c.n, 0)) END AS available
FROM evts e LEFT JOIN (SELECT event_id, COUNT(*) AS n FROM bookings WHERE event_id IS NOT NULL GROUP BY event_id) c
ON c.event_id = e.event_id ORDER BY e.site_id, e.event_date, e.event_time, e.event_id""")
def site_events_availability(r: Roles, site_id: int | None = None, measure: str = "bookings"):
    """Every event with bookings taken and seats left (NULL when capacity is 0: 'open').

    ``measure='bookings'`` counts bookings as the reference does;
    ``'tickets'`` sums no_of_tickets instead.
    """
    agg = F.count(F.lit(1)) if measure == "bookings" else F.sum("no_of_tickets")
    per = per_key(r.bookings, "event_id", [agg.cast("bigint").alias("booked_tickets")])
    e = r.evts if site_id is None else r.evts.where(F.col("site_id") == site_id)
    out = (e.select("event_id", "site_id", "name", "event_date", "event_time", "ticket_price", "capacity")
           .join(per, "event_id", "left").fillna({"booked_tickets": 0}))
    return out.withColumn("available", F.when(F.col("capacity") > 0, F.greatest(
        F.lit(0).cast("bigint"), F.col("capacity") - F.col("booked_tickets")))) \
        .orderBy("site_id", "event_date", "event_time", "event_id")


@query("D23", "site_latest_reviews", """
SELECT site_id, review_id, rating, comment, review_date, visitor_name FROM (
  SELECT r.site_id, r.review_id, r.rating, r.comment, r.review_date, v.full_name AS visitor_name,
         ROW_NUMBER() OVER (PARTITION BY r.site_id ORDER BY r.review_date DESC, r.review_id) AS rn
  FROM reviews r JOIN visitors v ON r.visitor_id = v.visitor_id WHERE r.site_id IS NOT NULL) t
WHERE rn <= 50""")
def site_latest_reviews(r: Roles, k: int = 50):
    """For every site, its latest k reviews with visitor name (per-group top-k)."""
    rv = semi(r.reviews.where(F.col("site_id").isNotNull()), r.visitors, "visitor_id", right_key="visitor_id")
    top = top_k_per_group(rv, "site_id", [F.desc("review_date"), F.asc("review_id")], k)
    return (top.join(r.visitors.select("visitor_id", F.col("full_name").alias("visitor_name")), "visitor_id")
            .select("site_id", "review_id", "rating", "comment", "review_date", "visitor_name"))


@query("D24", "site_page_aggregates", f"""
SELECT s.site_id, COALESCE(b.n, 0) AS total_bookings, rv.avg_rating, COALESCE(rv.n, 0) AS total_reviews,
       COALESCE(p.revenue, 0) AS revenue
FROM sites s
LEFT JOIN (SELECT site_id, COUNT(*) AS n FROM bookings WHERE site_id IS NOT NULL GROUP BY site_id) b
  ON b.site_id = s.site_id
LEFT JOIN (SELECT site_id, {s_ravgi('rating')} AS avg_rating, COUNT(*) AS n FROM reviews
           WHERE site_id IS NOT NULL GROUP BY site_id) rv ON rv.site_id = s.site_id
LEFT JOIN (SELECT b2.site_id, {s_sum('p.amount')} AS revenue FROM payments p JOIN bookings b2
           ON b2.booking_id = p.booking_id WHERE p.status = 'successful' AND b2.site_id IS NOT NULL
           GROUP BY b2.site_id) p ON p.site_id = s.site_id""")
def site_page_aggregates(r: Roles):
    """Per site: bookings, rounded average rating, reviews, successful revenue (fan-out safe)."""
    pay = per_key(r.payments, "booking_id", [F.sum("amount").alias("__amt")],
                  where=F.col("status") == SUCCESS)
    rev = (r.bookings.where(F.col("site_id").isNotNull()).select("booking_id", "site_id")
           .join(pay, "booking_id").select("site_id", "__amt"))
    out = branch_aggregate(
        r.sites.select("site_id"), "site_id",
        [(r.bookings, "site_id", [F.count(F.lit(1)).alias("total_bookings")]),
         (r.reviews, "site_id", [ravg_int("rating").alias("avg_rating"), F.count(F.lit(1)).alias("total_reviews")]),
         (rev, "site_id", [sum2("__amt").alias("revenue")])],
        fill={"total_bookings": 0, "total_reviews": 0})
    return out.withColumn("revenue", F.coalesce("revenue", _zero2()))


@query("D25", "site_guides", """
SELECT a.site_id, g.guide_id, g.full_name, g.language, g.specialization FROM assignments a
JOIN guides g ON g.guide_id = a.guide_id WHERE a.site_id IS NOT NULL ORDER BY a.site_id, g.full_name""")
def site_guides(r: Roles, site_id: int | None = None):
    """Guides assigned to each site."""
    a = r.assignments.where(F.col("site_id").isNotNull())
    if site_id is not None:
        a = a.where(F.col("site_id") == site_id)
    return (a.select("site_id", "guide_id").join(r.guides.select("guide_id", "full_name", "language",
                                                                   "specialization"), "guide_id")
            .select("site_id", "guide_id", "full_name", "language", "specialization").orderBy("site_id", "full_name"))


@query("D26", "related_sites", """
SELECT site_id, related_id, name, location, ticket_price FROM (
  SELECT s.site_id, o.site_id AS related_id, o.name, o.location, o.ticket_price,
         ROW_NUMBER() OVER (PARTITION BY s.site_id ORDER BY o.name, o.site_id) AS rn
  FROM sites s JOIN sites o ON o.type = s.type AND o.site_id <> s.site_id) t WHERE rn <= 6""")
def related_sites(r: Roles, k: int = 6):
    """For every site, the first k other sites of its type by name.

    Capped per type before joining: only the first k+1 sites of a type can be
    someone's first k others, so each site meets one list of at most k+1 candidates.
    Sites are dealt by their key before anything is sorted: no task sorts what one
    scan or one type yields.
    """
    sites = r.sites.select("site_id", "type", "name", "location", "ticket_price").repartition("site_id")
    cand = top_k_per_group(sites.withColumnRenamed("site_id", "related_id"), "type",
                           [F.asc("name"), F.asc("related_id")], k + 1)
    lists = cand.groupBy(F.col("type").alias("__t")).agg(
        F.array_sort(F.collect_list(F.struct("name", "related_id", "location", "ticket_price"))).alias("__c"))
    others = F.slice(F.filter("__c", lambda c: c["related_id"] != F.col("site_id")), 1, k)
    near = (sites.select("site_id", "type").join(lists, F.col("__t") == F.col("type"))
            .select("site_id", others.alias("__c")).repartition("site_id")
            .select("site_id", F.explode("__c").alias("__o")).select("site_id", "__o.*"))
    return (top_k_per_group(near, "site_id", [F.asc("name"), F.asc("related_id")], k)
            .select("site_id", "related_id", "name", "location", "ticket_price"))


@query("D27", "booking_detail_latest_payment", """
SELECT b.booking_id, b.visitor_id, b.no_of_tickets, b.booked_ticket_price, b.payment_status,
       COALESCE(s.name, e.name) AS target_name,
       lp.attempt_no AS last_attempt_no, lp.amount AS last_amount, lp.method AS last_method,
       lp.status AS last_status, lp.paid_at AS last_paid_at
FROM bookings b LEFT JOIN sites s ON b.site_id = s.site_id LEFT JOIN evts e ON b.event_id = e.event_id
LEFT JOIN (SELECT * FROM (SELECT p.*, ROW_NUMBER() OVER (PARTITION BY booking_id
           ORDER BY paid_at DESC, attempt_no DESC, acquirer_id DESC, amount DESC, method DESC, status DESC) AS rn
           FROM payments p) x WHERE rn = 1) lp
  ON lp.booking_id = b.booking_id""")
def booking_detail_latest_payment(r: Roles):
    """Every booking with its target name and its latest payment (max by paid_at, attempt)."""
    last = latest_per_key(r.payments.select("booking_id", "paid_at", "attempt_no", "acquirer_id", "amount",
                                            "method", "status"),
                          "booking_id", ["paid_at", "attempt_no", "acquirer_id", "amount", "method", "status"])
    last = last.select("booking_id", F.col("attempt_no").alias("last_attempt_no"),
                       F.col("amount").alias("last_amount"), F.col("method").alias("last_method"),
                       F.col("status").alias("last_status"), F.col("paid_at").alias("last_paid_at"))
    b = resolve_target(r.bookings, r.sites, r.evts, kind=None, salt_by="booking_id")
    return (b.join(last, "booking_id", "left")
            .select("booking_id", "visitor_id", "no_of_tickets", "booked_ticket_price", "payment_status",
                    "target_name", "last_attempt_no", "last_amount", "last_method", "last_status", "last_paid_at"))


@query("D28", "visitor_site_payments", """
SELECT b.visitor_id, p.payment_id, p.booking_id, p.attempt_no, p.method, p.status, p.amount, p.paid_at, s.name AS site_name
FROM payments p JOIN bookings b ON p.booking_id = b.booking_id JOIN sites s ON b.site_id = s.site_id
""")
def visitor_site_payments(r: Roles, visitor_id: int | None = None):
    """Each visitor's payments for site bookings, newest first (event bookings drop out).

    The payment's key makes the order total.  Rows are dealt out by ranges of the whole
    sort key, so a visitor with very many payments is spread over several tasks.
    """
    b = r.bookings.where(F.col("site_id").isNotNull()).select("booking_id", "visitor_id", "site_id")
    if visitor_id is not None:
        b = b.where(F.col("visitor_id") == visitor_id)
    j = (r.payments.join(b, "booking_id").join(r.sites.select("site_id", F.col("name").alias("site_name")),
                                               "site_id"))
    return (j.select("visitor_id", "payment_id", "booking_id", "attempt_no", "method", "status", "amount", "paid_at", "site_name")
            .orderBy("visitor_id", F.desc("paid_at"), F.desc("payment_id")))


@query("D29A", "visitor_bookings", """
SELECT b.*, s.name AS site_name, e.name AS event_name FROM bookings b
LEFT JOIN sites s ON b.site_id = s.site_id LEFT JOIN evts e ON b.event_id = e.event_id""")
def visitor_bookings(r: Roles, visitor_id: int | None = None):
    """Visitor profile: bookings with site and event names."""
    b = r.bookings if visitor_id is None else r.bookings.where(F.col("visitor_id") == visitor_id)
    return target_names(b, r.sites, r.evts, salt_by="booking_id")


@query("D29B", "visitor_payments", """
SELECT p.*, b.visitor_id FROM payments p JOIN bookings b ON p.booking_id = b.booking_id""")
def visitor_payments(r: Roles, visitor_id: int | None = None):
    """Visitor profile: payments keyed by visitor."""
    b = r.bookings.select("booking_id", "visitor_id")
    if visitor_id is not None:
        b = b.where(F.col("visitor_id") == visitor_id)
    return r.payments.join(b, "booking_id")


@query("D29C", "visitor_reviews", """
SELECT r.*, s.name AS site_name, e.name AS event_name FROM reviews r
LEFT JOIN sites s ON r.site_id = s.site_id LEFT JOIN evts e ON r.event_id = e.event_id""")
def visitor_reviews(r: Roles, visitor_id: int | None = None):
    """Visitor profile: reviews with site and event names."""
    rv = r.reviews if visitor_id is None else r.reviews.where(F.col("visitor_id") == visitor_id)
    return target_names(rv, r.sites, r.evts, salt_by="review_id")


@query("D29S", "visitor_360_summary", f"""
SELECT v.visitor_id, v.full_name, COALESCE(b.n, 0) AS bookings, b.spent AS booked_total, b.last_booking,
       COALESCE(p.n, 0) AS payments, p.paid AS paid_total, COALESCE(rv.n, 0) AS reviews, rv.avg_rating
FROM visitors v
LEFT JOIN (SELECT visitor_id, COUNT(*) AS n, {s_sum('booked_ticket_price')} AS spent, MAX(booking_date) AS last_booking
           FROM bookings GROUP BY visitor_id) b ON b.visitor_id = v.visitor_id
LEFT JOIN (SELECT b2.visitor_id, COUNT(*) AS n,
                  CAST(SUM(CASE WHEN p.status = 'successful' THEN p.amount END) AS DECIMAL(20,2)) AS paid
           FROM payments p JOIN bookings b2 ON p.booking_id = b2.booking_id GROUP BY b2.visitor_id) p
  ON p.visitor_id = v.visitor_id
LEFT JOIN (SELECT visitor_id, COUNT(*) AS n, {s_ravgi('rating')} AS avg_rating FROM reviews GROUP BY visitor_id) rv
  ON rv.visitor_id = v.visitor_id""")
def visitor_360_summary(r: Roles):
    """Visitor 360 in bulk: bookings, spend, last booking, payments, paid total, reviews, rating per visitor.

    Payments are first summed per booking, then per visitor through the
    booking's visitor; each branch is aggregated on its own key (A6).
    """
    per_booking = r.payments.groupBy("booking_id").agg(
        F.count(F.lit(1)).alias("__pn"),
        F.sum(F.when(F.col("status") == SUCCESS, F.col("amount"))).alias("__pa"))
    pay = (per_booking.join(r.bookings.select("booking_id", "visitor_id"), "booking_id")
           .select("visitor_id", "__pn", "__pa"))
    out = branch_aggregate(
        r.visitors.select("visitor_id", "full_name"), "visitor_id",
        [(r.bookings, "visitor_id", [F.count(F.lit(1)).alias("bookings"),
                                     sum2("booked_ticket_price").alias("booked_total"),
                                     F.max("booking_date").alias("last_booking")]),
         (pay, "visitor_id", [F.sum("__pn").alias("payments"), sum2("__pa").alias("paid_total")]),
         (r.reviews, "visitor_id", [F.count(F.lit(1)).alias("reviews"), ravg_int("rating").alias("avg_rating")])],
        fill={"bookings": 0, "payments": 0, "reviews": 0})
    return out.select("visitor_id", "full_name", "bookings", "booked_total", "last_booking", "payments",
                      "paid_total", "reviews", "avg_rating")


@query("D30", "visitor_avg_rating", f"""
SELECT v.visitor_id, t.avg_rating FROM visitors v
LEFT JOIN (SELECT visitor_id, {s_ravgi('rating')} AS avg_rating FROM reviews GROUP BY visitor_id) t
  ON t.visitor_id = v.visitor_id""")
def visitor_avg_rating(r: Roles):
    """Each visitor's ROUND(AVG(rating), 2), NULL without reviews."""
    per = per_key(r.reviews, "visitor_id", [ravg_int("rating").alias("avg_rating")])
    return r.visitors.select("visitor_id").join(per, "visitor_id", "left")


_FACETS = [("sites", "location"), ("sites", "type"), ("guides", "language"), ("visitors", "nationality")]


@query("D31", "filter_facets", " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS facet, {c} AS value, COUNT(*) AS cnt FROM {t} WHERE {c} IS NOT NULL AND {c} <> '' "
    f"GROUP BY {c}" for t, c in _FACETS))
def filter_facets(r: Roles):
    """Filter option lists: distinct non-empty values with counts per facet column.

    One scan per table: each row emits one (facet, value) entry per faceted
    column, then a single grouped count.
    """
    tables = r.as_dict()
    out = None
    for t in dict.fromkeys(t for t, _ in _FACETS):
        cols = [c for tt, c in _FACETS if tt == t]
        entries = F.array(*[F.struct(F.lit(f"{t}.{c}").alias("facet"), F.col(c).cast("string").alias("value"))
                            for c in cols])
        e = tables[t].select(F.explode(entries).alias("e")).select("e.facet", "e.value")
        e = e.where(F.col("value").isNotNull() & (F.col("value") != ""))
        g = e.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("cnt"))
        out = g if out is None else out.unionByName(g)
    return out


@query("D31G", "guide_options", "SELECT guide_id, full_name FROM guides ORDER BY full_name")
def guide_options(r: Roles):
    """Dropdown list: guides by name."""
    return r.guides.select("guide_id", "full_name").orderBy("full_name", "guide_id")


@query("D31S", "site_options", "SELECT site_id, name FROM sites ORDER BY name")
def site_options(r: Roles):
    """Dropdown list: sites by name."""
    return r.sites.select("site_id", "name").orderBy("name", "site_id")


@query("D31E", "event_options", "SELECT event_id, name, site_id, event_date FROM evts ORDER BY event_date DESC")
def event_options(r: Roles):
    """Dropdown list: events, newest first."""
    return r.evts.select("event_id", "name", "site_id", "event_date").orderBy(F.desc("event_date"), "event_id")


@query("D32", "site_price_stats", f"""
SELECT COUNT(*) AS total, MIN(ticket_price) AS min_price, MAX(ticket_price) AS max_price,
       {s_avg('ticket_price')} AS avg_price FROM sites""")
def site_price_stats(r: Roles):
    """Global site price stats (the filtered form is the listing's stats, L2)."""
    return r.sites.agg(F.count(F.lit(1)).alias("total"), F.min("ticket_price").alias("min_price"),
                       F.max("ticket_price").alias("max_price"), avg_exact("ticket_price").alias("avg_price"))


@query("D32B", "event_price_range", """
SELECT MIN(ticket_price) AS min_price, CAST(MAX(ticket_price) + 1 AS DECIMAL(11,2)) AS max_price FROM evts""")
def event_price_range(r: Roles):
    """Event price range with the +1 padding of the upper bound."""
    return r.evts.agg(F.min("ticket_price").alias("min_price"),
                      (F.max("ticket_price") + 1).cast("decimal(11,2)").alias("max_price"))


@query("D33", "guide_stats", f"""
SELECT {s_avg('salary')} AS avg_salary, COUNT(*) AS total_guides,
       (SELECT COUNT(*) FROM guides g LEFT JOIN assignments a ON g.guide_id = a.guide_id
        WHERE a.guide_id IS NULL) AS unassigned FROM guides""")
def guide_stats(r: Roles):
    """Guide KPIs: average salary, total, unassigned (left-join null count)."""
    unassigned = _count(anti(r.guides, r.assignments, "guide_id", right_key="guide_id"), "n").scalar()
    return r.guides.agg(avg_exact("salary").alias("avg_salary"), F.count(F.lit(1)).alias("total_guides")) \
        .withColumn("unassigned", unassigned)


@query("D33B", "guides_per_language_all", """
SELECT language, COUNT(*) AS cnt FROM guides GROUP BY language ORDER BY cnt DESC""")
def guides_per_language_all(r: Roles):
    """Guides per language (all)."""
    return group_count(r.guides, "language").orderBy(F.desc("cnt"))


@query("D34", "payment_stats", f"""
SELECT COUNT(*) AS total_payments, COALESCE({s_sum('amount')}, 0) AS total_amount FROM payments""")
def payment_stats(r: Roles):
    """Payment KPIs: count and total amount."""
    return r.payments.agg(F.count(F.lit(1)).alias("total_payments"),
                          F.coalesce(sum2("amount"), _zero2()).alias("total_amount"))


@query("D34B", "payments_per_method", """SELECT method, COUNT(*) AS cnt FROM payments GROUP BY method""")
def payments_per_method(r: Roles):
    """Payments per method."""
    return group_count(r.payments, "method")
