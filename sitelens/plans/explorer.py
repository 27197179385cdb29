"""Public explorer catalogue C-X01..C-X18."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import contains_like, excerpt, ravg, sum2
from sitelens.operators.aggs import branch_aggregate, group_count, per_key
from sitelens.operators.aggs import capped
from sitelens.operators.joins import anti, semi
from sitelens.operators.sets import intersect_by_key, union_distinct
from sitelens.operators.windows import rank_by
from sitelens.plans.registry import query
from sitelens.plans.sqlfrag import s_ravg, s_sum
from sitelens.sources.roles import Roles

SUCCESS = "successful"


@query("C-X01", "orderby_ticket_desc", """
SELECT site_id, name, ticket_price FROM sites ORDER BY ticket_price DESC NULLS LAST, site_id""")
def orderby_ticket_desc(r: Roles, k: int | None = None):
    """Order sites by ticket_price DESC (top-k)."""
    return (r.sites.select("site_id", "name", "ticket_price")
            .orderBy(F.desc("ticket_price"), "site_id").transform(capped, k))


@query("C-X02", "count_sites_by_location", """
SELECT location, COUNT(*) AS cnt FROM sites GROUP BY location ORDER BY cnt DESC""")
def count_sites_by_location(r: Roles, ci: bool = False):
    """Count of sites by location (``ci=True``: case/accent-insensitive groups)."""
    return group_count(r.sites, "location", ci=ci).orderBy(F.desc("cnt"), "location")


@query("C-X03", "price_aggregates", f"""
SELECT MIN(ticket_price) AS min_price, MAX(ticket_price) AS max_price,
       {s_ravg('ticket_price')} AS avg_price, {s_sum('ticket_price')} AS sum_price FROM sites""")
def price_aggregates(r: Roles):
    """MIN, MAX, ROUND(AVG), ROUND(SUM) of ticket_price; one row even on empty input."""
    return r.sites.agg(F.min("ticket_price").alias("min_price"), F.max("ticket_price").alias("max_price"),
                       ravg("ticket_price").alias("avg_price"), sum2("ticket_price").alias("sum_price"))


@query("C-X04", "locations_with_many_sites", """
SELECT location, COUNT(*) AS cnt FROM sites GROUP BY location HAVING COUNT(*) > 2 ORDER BY cnt DESC""")
def locations_with_many_sites(r: Roles, min_sites: int = 2, ci: bool = False):
    """Locations having more than ``min_sites`` sites (HAVING on an alias)."""
    return (group_count(r.sites, "location", ci=ci).where(F.col("cnt") > min_sites)
            .orderBy(F.desc("cnt"), "location"))


@query("C-X05", "like_museum", """
SELECT site_id, name, LEFT(description, 120) AS excerpt FROM sites
WHERE name LIKE '%museum%' OR description LIKE '%museum%' ORDER BY site_id""")
def like_museum(r: Roles, word: str = "museum", ci: bool = False, k: int | None = None):
    """Sites whose name or description contains ``word`` (LIKE).

    The reference's unordered ``LIMIT 200`` display cap is opt-in (``k``);
    by default every match is returned, ordered by id.
    """
    s = r.sites
    out = (s.where(contains_like("name", word, ci) | contains_like("description", word, ci))
           .select("site_id", "name", excerpt("description", 120).alias("excerpt")).orderBy("site_id"))
    return out.limit(k) if k else out


@query("C-X06", "sites_with_bookings_in", """
SELECT DISTINCT s.site_id, s.name FROM sites s
WHERE s.site_id IN (SELECT site_id FROM bookings WHERE site_id IS NOT NULL) ORDER BY s.name""")
def sites_with_bookings_in(r: Roles):
    """Sites that have bookings (IN subquery → semi join; DISTINCT is implied by the key)."""
    return semi(r.sites, r.bookings, "site_id", right_key="site_id").select("site_id", "name").orderBy("name", "site_id")


@query("C-X07", "sites_with_events_exists", """
SELECT s.site_id, s.name FROM sites s WHERE EXISTS (SELECT 1 FROM evts e WHERE e.site_id = s.site_id) ORDER BY s.name""")
def sites_with_events_exists(r: Roles):
    """Sites that have events (EXISTS)."""
    return semi(r.sites, r.evts, "site_id", right_key="site_id").select("site_id", "name").orderBy("name", "site_id")


@query("C-X08", "sites_without_bookings", """
SELECT s.site_id, s.name FROM sites s WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.site_id = s.site_id)
ORDER BY s.name""")
def sites_without_bookings(r: Roles):
    """Sites without bookings (NOT EXISTS → anti join)."""
    return anti(r.sites, r.bookings, "site_id", right_key="site_id").select("site_id", "name").orderBy("name", "site_id")


@query("C-X09", "union_sites_and_events_names", """
SELECT * FROM (SELECT name, 'site' AS type FROM sites UNION SELECT name, 'event' AS type FROM evts) u
ORDER BY name, type""")
def union_sites_and_events_names(r: Roles, k: int | None = None):
    """UNION of site names and event names with a literal tag (the unordered cap is opt-in via ``k``)."""
    u = union_distinct(r.sites.select("name", F.lit("site").alias("type")),
                       r.evts.select("name", F.lit("event").alias("type"))).orderBy("name", "type")
    return u.limit(k) if k else u


@query("C-X10", "intersect_emulated_sites_with_both_booking_and_event", """
SELECT DISTINCT s.site_id, s.name FROM sites s JOIN bookings b ON b.site_id = s.site_id
JOIN evts e ON e.site_id = s.site_id ORDER BY s.name, s.site_id""")
def intersect_emulated(r: Roles, k: int | None = None):
    """Sites with both bookings and events: two semi joins, no bookings×events fan-out."""
    s = intersect_by_key(r.sites, "site_id", (r.bookings, "site_id"), (r.evts, "site_id"))
    return s.select("site_id", "name").orderBy("name", "site_id").transform(capped, k)


def target_revenue(r: Roles, target: str = "site_id", statuses=(SUCCESS,)):
    """Per target id (site_id or event_id): successful revenue and booking count.

    Payments are summed per booking first (partial aggregate), then per
    target; never a target×bookings×payments fan-out.  Revenue is NULL for a
    target whose bookings have no successful payment.
    """
    pay = per_key(r.payments, "booking_id", [F.sum("amount").alias("__amt")],
                  where=F.col("status").isin(*statuses))
    b = r.bookings.where(F.col(target).isNotNull()).select("booking_id", target)
    return (b.join(pay, "booking_id", "left").groupBy(target)
            .agg(sum2("__amt").alias("revenue"), F.count("booking_id").alias("bookings")))


def site_revenue_frame(r: Roles, statuses=(SUCCESS,)):
    """Every site with its successful revenue (NULL when none) and booking count."""
    return (r.sites.select("site_id", "name").join(target_revenue(r, "site_id", statuses), "site_id", "left")
            .fillna({"bookings": 0}))


@query("C-X11", "site_revenue", f"""
SELECT s.site_id, s.name, {s_sum('p.amount')} AS revenue, COUNT(DISTINCT b.booking_id) AS bookings
FROM sites s LEFT JOIN bookings b ON b.site_id = s.site_id
LEFT JOIN payments p ON p.booking_id = b.booking_id AND p.status = 'successful'
GROUP BY s.site_id, s.name ORDER BY revenue DESC NULLS LAST, s.site_id""")
def site_revenue(r: Roles, k: int | None = None):
    """Site revenue (SUM of successful payments, NULL when none) and booking count, top k."""
    return (site_revenue_frame(r).select("site_id", "name", "revenue", "bookings")
            .orderBy(F.desc("revenue"), "site_id").transform(capped, k))


@query("C-X12", "sites_revenue_gt_500", f"""
SELECT s.site_id, s.name, CAST(COALESCE(SUM(p.amount), 0) AS DECIMAL(20,2)) AS revenue
FROM sites s LEFT JOIN bookings b ON b.site_id = s.site_id
LEFT JOIN payments p ON p.booking_id = b.booking_id AND p.status = 'successful'
GROUP BY s.site_id, s.name HAVING COALESCE(SUM(p.amount), 0) > 500
ORDER BY revenue DESC, s.site_id""")
def sites_revenue_gt_500(r: Roles, threshold: float = 500, k: int | None = None):
    """Sites whose successful revenue (0 when none) exceeds ``threshold``."""
    f = site_revenue_frame(r).select("site_id", "name",
                                     F.coalesce("revenue", F.lit(0).cast("decimal(20,2)")).alias("revenue"))
    return f.where(F.col("revenue") > threshold).orderBy(F.desc("revenue"), "site_id").transform(capped, k)


def bookings_per_site(r: Roles, out: str):
    per = per_key(r.bookings, "site_id", [F.count(F.lit(1)).alias(out)])
    return r.sites.select("site_id", "name").join(per, "site_id", "left").fillna({out: 0})


@query("C-X13", "top_sites_by_bookings", """
SELECT s.site_id, s.name, COUNT(b.booking_id) AS total_bookings FROM sites s
LEFT JOIN bookings b ON b.site_id = s.site_id GROUP BY s.site_id, s.name
ORDER BY total_bookings DESC, s.site_id LIMIT 10""")
def top_sites_by_bookings(r: Roles, k: int = 10):
    """Top k sites by number of bookings (zero kept)."""
    return bookings_per_site(r, "total_bookings").orderBy(F.desc("total_bookings"), "site_id").limit(k)


@query("C-X14", "min_max_ticket_per_type", """
SELECT type, MIN(ticket_price) AS min_price, MAX(ticket_price) AS max_price FROM sites GROUP BY type""")
def min_max_ticket_per_type(r: Roles):
    """MIN and MAX ticket_price per type."""
    return r.sites.groupBy("type").agg(F.min("ticket_price").alias("min_price"),
                                       F.max("ticket_price").alias("max_price"))


@query("C-X15", "site_with_latest_event_date", """
SELECT s.site_id, s.name, (SELECT MAX(event_date) FROM evts e WHERE e.site_id = s.site_id) AS latest_event
FROM sites s ORDER BY latest_event DESC NULLS LAST, s.site_id""")
def site_with_latest_event_date(r: Roles, k: int | None = None):
    """Correlated scalar MAX per site → pre-aggregated left join; top k by date."""
    latest = per_key(r.evts, "site_id", [F.max("event_date").alias("latest_event")])
    return (r.sites.select("site_id", "name").join(latest, "site_id", "left")
            .orderBy(F.desc("latest_event"), "site_id").transform(capped, k))


@query("C-X16", "rank_sites_by_price", """
SELECT site_id, name, ticket_price, RANK() OVER (ORDER BY ticket_price DESC) AS price_rank FROM sites""")
def rank_sites_by_price(r: Roles):
    """RANK() OVER (ORDER BY ticket_price DESC), computed without a one-partition window."""
    return rank_by(r.sites.select("site_id", "name", "ticket_price"), "ticket_price", "price_rank")


@query("C-X17", "view_sites_summary", """
SELECT s.site_id, s.name, COUNT(DISTINCT e.event_id) AS event_count, COUNT(DISTINCT b.booking_id) AS booking_count
FROM sites s LEFT JOIN evts e ON e.site_id = s.site_id LEFT JOIN bookings b ON b.site_id = s.site_id
GROUP BY s.site_id, s.name ORDER BY booking_count DESC, s.site_id""")
def view_sites_summary(r: Roles, k: int | None = None):
    """Events and bookings per site: two branch aggregates, never events×bookings."""
    out = branch_aggregate(
        r.sites.select("site_id", "name"), "site_id",
        [(r.evts, "site_id", [F.count(F.lit(1)).alias("event_count")]),
         (r.bookings, "site_id", [F.count(F.lit(1)).alias("booking_count")])],
        fill={"event_count": 0, "booking_count": 0})
    return out.orderBy(F.desc("booking_count"), "site_id").transform(capped, k)


@query("C-X18", "sites_in_bookings_not_in_reviews", """
SELECT DISTINCT s.site_id, s.name FROM sites s
WHERE EXISTS (SELECT 1 FROM bookings b WHERE b.site_id = s.site_id)
AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.site_id = s.site_id) ORDER BY s.name""")
def sites_in_bookings_not_in_reviews(r: Roles):
    """Sites with bookings but no reviews: semi then anti."""
    s = anti(semi(r.sites, r.bookings, "site_id", right_key="site_id"), r.reviews, "site_id", right_key="site_id")
    return s.select("site_id", "name").orderBy("name", "site_id")
