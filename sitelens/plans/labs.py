"""Lab statements B01..B15 (SELECT labs, joins, set operations, DML and DDL as table jobs).

The unbounded CROSS JOIN of visitors × guides (a lab statement) is
deliberately not registered: its output grows with |visitors|·|guides|.  The
bounded cross-join demos (C-S21, C-E18, C-G16, C-A17) cover the operator.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from sitelens.functions import avg_exact, contains_like, day_lit, ravg, ravg_int, sum2
from sitelens.operators.aggs import group_count, per_key
from sitelens.operators.joins import anti, left_expand, not_in, pair_counts, semi
from sitelens.operators.sets import except_, intersect, union_distinct
from sitelens.plans.registry import query
from sitelens.plans.sqlfrag import s_avg, s_avgi, s_ravg, s_ravgi, s_sum
from sitelens.sources.roles import Roles



@query("B01A", "scan_visitors", "SELECT * FROM visitors")
def scan_visitors(r: Roles):
    """SELECT * FROM visitors."""
    return r.visitors


@query("B01B", "distinct_nationality", "SELECT DISTINCT nationality FROM visitors")
def distinct_nationality(r: Roles):
    """SELECT DISTINCT nationality."""
    return r.visitors.select("nationality").distinct()


@query("B01C", "select_all_name_location", "SELECT ALL name, location FROM sites")
def select_all_name_location(r: Roles):
    """SELECT ALL (duplicates kept)."""
    return r.sites.select("name", "location")


@query("B02A", "visitors_name_prefix", "SELECT * FROM visitors WHERE full_name LIKE 'A%'")
def visitors_name_prefix(r: Roles, prefix: str = "A"):
    """LIKE 'A%' prefix match."""
    from sitelens.functions.text import like_escape
    return r.visitors.where(F.startswith("full_name", F.lit(prefix)))


@query("B02B", "guides_language_like", "SELECT * FROM guides WHERE language LIKE '%English%'")
def guides_language_like(r: Roles, word: str = "English"):
    """LIKE '%English%' substring match."""
    return r.guides.where(contains_like("language", word))


@query("B03", "basic_aggregates", f"""
SELECT (SELECT COUNT(*) FROM sites) AS total_sites, (SELECT {s_avg('ticket_price')} FROM evts) AS avg_ticket,
       (SELECT MAX(rating) FROM reviews) AS best_rating""")
def basic_aggregates(r: Roles):
    """COUNT sites, AVG event price, MAX rating (one row)."""
    return (r.sites.select(F.count(F.lit(1)).alias("total_sites"))
            .withColumn("avg_ticket", r.evts.select(avg_exact("ticket_price")).scalar())
            .withColumn("best_rating", r.reviews.select(F.max("rating")).scalar()))


@query("B04", "nationality_having", """
SELECT nationality, COUNT(*) AS total_visitors FROM visitors GROUP BY nationality HAVING COUNT(*) > 1""")
def nationality_having(r: Roles, min_visitors: int = 1):
    """Visitors per nationality, HAVING > n."""
    return group_count(r.visitors, "nationality", "total_visitors").where(F.col("total_visitors") > min_visitors)


@query("B05", "sites_with_pricey_events", """
SELECT name, location FROM sites WHERE site_id IN (SELECT site_id FROM evts WHERE ticket_price > 100)""")
def sites_with_pricey_events(r: Roles, min_price: float = 100):
    """IN subquery on events priced above n."""
    return semi(r.sites, r.evts.where(F.col("ticket_price") > min_price), "site_id", right_key="site_id") \
        .select("name", "location")


@query("B06", "union_pricey_items", """
SELECT site_id AS id, name FROM sites WHERE ticket_price > 100
UNION SELECT event_id, name FROM evts WHERE ticket_price > 100""")
def union_pricey_items(r: Roles, min_price: float = 100):
    """UNION of priced sites and events (by position)."""
    return union_distinct(r.sites.where(F.col("ticket_price") > min_price).select(F.col("site_id").alias("id"), "name"),
                          r.evts.where(F.col("ticket_price") > min_price).select("event_id", "name"))


def top_rated_sites(r: Roles, min_avg: float = 4):
    """View TopRatedSites: average rating per site *name* above n (exact, scale 4)."""
    per_site = per_key(r.reviews, "site_id", [F.sum("rating").alias("__s"), F.count("rating").alias("__c")])
    j = per_site.join(r.sites.select("site_id", "name"), "site_id")
    g = j.groupBy("name").agg((F.sum("__s").cast("decimal(20,0)") / F.sum("__c")).cast("decimal(14,4)")
                              .alias("avg_rating"))
    return g.where(F.col("avg_rating") > min_avg)


@query("B07", "top_rated_sites_view", f"""
SELECT s.name, {s_avgi('r.rating')} AS avg_rating FROM sites s JOIN reviews r ON s.site_id = r.site_id
GROUP BY s.name HAVING {s_avgi('r.rating')} > 4""")
def top_rated_sites_view(r: Roles, register: bool = False, min_avg: float = 4):
    """Q4 stored view TopRatedSites; ``register=True`` also creates the temp view."""
    df = top_rated_sites(r, min_avg)
    if register:
        df.createOrReplaceTempView("TopRatedSites")
    return df


@query("B08A", "inner_join_visitors_bookings", """
SELECT v.full_name, b.booking_date FROM visitors v JOIN bookings b ON v.visitor_id = b.visitor_id""")
def inner_join_visitors_bookings(r: Roles):
    """Inner join."""
    return (r.bookings.select("visitor_id", "booking_date")
            .join(r.visitors.select("visitor_id", "full_name"), "visitor_id").select("full_name", "booking_date"))


@query("B08B", "left_join_sites_events", """
SELECT s.name, e.name AS event_name FROM sites s LEFT JOIN evts e ON s.site_id = e.site_id""")
def left_join_sites_events_lab(r: Roles):
    """Left outer join."""
    e = r.evts.select(F.col("site_id").alias("__sid"), F.col("name").alias("event_name"))
    return left_expand(r.sites.select("site_id", "name"), e, "site_id", "__sid").select("name", "event_name")


@query("B08C", "right_join_sites_events", """
SELECT s.name, e.name AS event_name FROM sites s RIGHT JOIN evts e ON s.site_id = e.site_id""")
def right_join_sites_events(r: Roles):
    """Right outer join."""
    s = r.sites.select(F.col("site_id").alias("__sid"), "name")
    e = r.evts.select("site_id", F.col("name").alias("event_name"))
    return s.join(e, F.col("site_id") == F.col("__sid"), "right").select("name", "event_name")


@query("B08D", "full_join_sites_events", """
SELECT s.name, e.name AS event_name FROM sites s LEFT JOIN evts e ON s.site_id = e.site_id
UNION SELECT s.name, e.name FROM sites s RIGHT JOIN evts e ON s.site_id = e.site_id""")
def full_join_sites_events(r: Roles):
    """Full outer join as LEFT ∪ RIGHT, then DISTINCT (as UNION does).

    Built as (events LEFT JOIN sites) ∪ (sites without events): AQE can split
    a skewed left side of each part, which it cannot do for a full outer join
    (a site holding a third of all events stays one reducer otherwise).
    """
    s = r.sites.select(F.col("site_id").alias("__sid"), "name")
    e = r.evts.select("site_id", F.col("name").alias("event_name"))
    events_side = e.join(s, F.col("site_id") == F.col("__sid"), "left").select("name", "event_name")
    lonely = anti(r.sites, r.evts, "site_id", right_key="site_id").select("name", F.lit(None).cast("string")
                                                                          .alias("event_name"))
    return events_side.unionByName(lonely).distinct()


@query("B09A", "natural_join_bookings_payments", "SELECT * FROM bookings NATURAL JOIN payments")
def natural_join_bookings_payments(r: Roles):
    """NATURAL JOIN: the only common column of the two tables is booking_id."""
    common = [c for c in r.bookings.columns if c in r.payments.columns]
    return r.bookings.join(r.payments, common)


@query("B09C", "comma_equi_join", """
SELECT v.full_name, b.no_of_tickets FROM visitors v, bookings b WHERE v.visitor_id = b.visitor_id""")
def comma_equi_join(r: Roles):
    """Implicit (comma) equi join."""
    return (r.bookings.select("visitor_id", "no_of_tickets").join(r.visitors.select("visitor_id", "full_name"),
                                                                   "visitor_id").select("full_name", "no_of_tickets"))


@query("B10A", "theta_join_ticket_total", """
SELECT v.full_name AS visitor_name, e.name AS event_name, e.ticket_price FROM visitors v
JOIN bookings b ON v.visitor_id = b.visitor_id JOIN evts e ON b.event_id = e.event_id
WHERE b.no_of_tickets * e.ticket_price > 200""")
def theta_join_ticket_total(r: Roles, threshold: float = 200):
    """Predicate across joined tables: tickets × event price above n."""
    b = r.bookings.where(F.col("event_id").isNotNull()).select("visitor_id", "event_id", "no_of_tickets")
    j = b.join(r.evts.select("event_id", F.col("name").alias("event_name"), "ticket_price"), "event_id") \
        .where(F.col("no_of_tickets") * F.col("ticket_price") > threshold)
    return (j.join(r.visitors.select("visitor_id", F.col("full_name").alias("visitor_name")), "visitor_id")
            .select("visitor_name", "event_name", "ticket_price"))


@query("B10B", "self_join_same_language", """
SELECT language, COUNT(*) AS n, SUM(before) AS n_pairs FROM (
  SELECT language, RANK() OVER (PARTITION BY language ORDER BY guide_id) - 1 AS before FROM guides) t
WHERE language IS NOT NULL GROUP BY language HAVING MAX(before) > 0""")
def self_join_same_language(r: Roles):
    """Self join with '<' residual: rows and pairs per language."""
    return pair_counts(r.guides, "language", "<")


@query("B11A", "sites_price_between", "SELECT name, ticket_price FROM sites WHERE ticket_price BETWEEN 100 AND 500")
def sites_price_between(r: Roles, lo: float = 100, hi: float = 500):
    """BETWEEN range."""
    return r.sites.where(F.col("ticket_price").between(lo, hi)).select("name", "ticket_price")


@query("B11B", "guides_english_or_bangla", """
SELECT full_name, language FROM guides WHERE language LIKE '%English%' OR language LIKE '%Bangla%'""")
def guides_english_or_bangla(r: Roles, words=("English", "Bangla")):
    """OR of LIKE predicates."""
    pred = F.lit(False)
    for w in words:
        pred = pred | contains_like("language", w)
    return r.guides.where(pred).select("full_name", "language")


@query("B11C", "events_next_7_days", """
SELECT name, event_date FROM evts WHERE event_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-22'""")
def events_next_7_days(r: Roles, days: int = 7):
    """Events from as_of to as_of + n days."""
    start = day_lit(r.as_of_events)
    return r.evts.where(F.col("event_date").between(start, F.date_add(start, days))).select("name", "event_date")


@query("B11D", "sites_at_location", """
SELECT name, location, ticket_price FROM sites WHERE location = 'Dhaka' ORDER BY ticket_price DESC""")
def sites_at_location(r: Roles, location: str = "Dhaka"):
    """Equality filter then ORDER BY price DESC."""
    return (r.sites.where(F.col("location") == location).select("name", "location", "ticket_price")
            .orderBy(F.desc("ticket_price")))


@query("B11E", "visitors_email_domain", """
SELECT full_name, email FROM visitors WHERE email LIKE '%@gmail.com%'""")
def visitors_email_domain(r: Roles, domain: str = "@gmail.com"):
    """Substring LIKE on email."""
    return r.visitors.where(contains_like("email", domain)).select("full_name", "email")


@query("B12A", "revenue_by_method_all", f"""
SELECT method, {s_sum('amount')} AS total_revenue FROM payments GROUP BY method ORDER BY total_revenue DESC""")
def revenue_by_method_all(r: Roles):
    """SUM(amount) per method."""
    return r.payments.groupBy("method").agg(sum2("amount").alias("total_revenue")).orderBy(F.desc("total_revenue"))


@query("B12B", "avg_salary_rounded", f"SELECT {s_ravg('salary')} AS avg_salary FROM guides")
def avg_salary_rounded(r: Roles):
    """ROUND(AVG(salary), 2)."""
    return r.guides.select(ravg("salary").alias("avg_salary"))


@query("B12C", "ratings_per_site", f"""
SELECT site_id, COUNT(*) AS total_reviews, {s_ravgi('rating', 1)} AS avg_rating FROM reviews GROUP BY site_id
HAVING COUNT(*) >= 2""")
def ratings_per_site(r: Roles, min_reviews: int = 2):
    """Reviews and ROUND(AVG(rating), 1) per site (NULL site included), HAVING ≥ n."""
    return (r.reviews.groupBy("site_id").agg(F.count(F.lit(1)).alias("total_reviews"),
                                             ravg_int("rating", 1).alias("avg_rating"))
            .where(F.col("total_reviews") >= min_reviews))


@query("B12D", "bookings_count_per_visitor", """
SELECT visitor_id, COUNT(*) AS bookings FROM bookings GROUP BY visitor_id""")
def bookings_count_per_visitor(r: Roles):
    """Bookings per visitor id."""
    return group_count(r.bookings, "visitor_id", "bookings")


@query("B12E", "price_range_per_type", """
SELECT type, MAX(ticket_price) AS max_price, MIN(ticket_price) AS min_price FROM sites GROUP BY type""")
def price_range_per_type(r: Roles):
    """MAX and MIN price per type."""
    return r.sites.groupBy("type").agg(F.max("ticket_price").alias("max_price"), F.min("ticket_price").alias("min_price"))


@query("B13A", "site_names_with_events", "SELECT name FROM sites WHERE site_id IN (SELECT site_id FROM evts)")
def site_names_with_events(r: Roles):
    """IN subquery."""
    return semi(r.sites, r.evts, "site_id", right_key="site_id").select("name")


@query("B13B", "guide_names_not_assigned", """
SELECT full_name FROM guides WHERE guide_id NOT IN (SELECT guide_id FROM assignments)""")
def guide_names_not_assigned(r: Roles):
    """NOT IN subquery."""
    return not_in(r.guides, "guide_id", r.assignments, "guide_id").select("full_name")


@query("B13C", "visitors_booked_not_reviewed", """
SELECT full_name FROM visitors WHERE visitor_id IN (SELECT visitor_id FROM bookings)
AND visitor_id NOT IN (SELECT visitor_id FROM reviews)""")
def visitors_booked_not_reviewed(r: Roles):
    """IN + NOT IN."""
    v = semi(r.visitors, r.bookings, "visitor_id", right_key="visitor_id")
    return not_in(v, "visitor_id", r.reviews, "visitor_id").select("full_name")


def _sites_in(r: Roles, df):
    return semi(r.sites.select("site_id", "name"), df, "site_id", right_key="site_id")


def _events_in(r: Roles, df):
    return semi(r.evts.select("event_id", "name"), df, "event_id", right_key="event_id")


@query("B13D", "union_booked_or_reviewed_sites", """
SELECT site_id, name FROM sites WHERE site_id IN (SELECT site_id FROM bookings)
UNION SELECT site_id, name FROM sites WHERE site_id IN (SELECT site_id FROM reviews)""")
def union_booked_or_reviewed_sites(r: Roles):
    """UNION."""
    return union_distinct(_sites_in(r, r.bookings), _sites_in(r, r.reviews))


@query("B13E", "intersect_booked_reviewed_events", """
SELECT event_id, name FROM evts WHERE event_id IN (SELECT event_id FROM bookings)
INTERSECT SELECT event_id, name FROM evts WHERE event_id IN (SELECT event_id FROM reviews)""")
def intersect_booked_reviewed_events(r: Roles):
    """INTERSECT."""
    return intersect(_events_in(r, r.bookings), _events_in(r, r.reviews))


@query("B13F", "except_reviewed_not_booked_sites", """
SELECT site_id, name FROM sites WHERE site_id IN (SELECT site_id FROM reviews)
EXCEPT SELECT site_id, name FROM sites WHERE site_id IN (SELECT site_id FROM bookings)""")
def except_reviewed_not_booked_sites(r: Roles):
    """EXCEPT."""
    return except_(_sites_in(r, r.reviews), _sites_in(r, r.bookings))


@query("U2", "intersect_booked_reviewed_sites", """
SELECT site_id FROM bookings WHERE site_id IS NOT NULL INTERSECT SELECT site_id FROM reviews WHERE site_id IS NOT NULL""")
def intersect_booked_reviewed_sites(r: Roles):
    """INTERSECT of booked and reviewed site ids."""
    return intersect(r.bookings.where(F.col("site_id").isNotNull()).select("site_id"),
                     r.reviews.where(F.col("site_id").isNotNull()).select("site_id"))


# ---------------------------------------------------------------- DML / DDL labs as table jobs

@query("B14A", "update_site_price", """
SELECT site_id, name, location, type,
       CASE WHEN site_id = 1 THEN CAST(200 AS DECIMAL(10,2)) ELSE ticket_price END AS ticket_price,
       unesco_status, description, created_at, opening_hours FROM sites""")
def update_site_price(r: Roles, site_id: int = 1, price: str = "200"):
    """UPDATE sites SET ticket_price = p WHERE site_id = k, as a new version of the table."""
    from sitelens.jobs.upsert import update_where
    return update_where(r.sites, F.col("site_id") == site_id, {"ticket_price": F.lit(price).cast("decimal(10,2)")})


@query("B14B", "raise_guide_salary", """
SELECT guide_id, full_name, language, specialization,
       CASE WHEN guide_id = 1 THEN CAST(salary + 5000 AS DECIMAL(10,2)) ELSE salary END AS salary FROM guides""")
def raise_guide_salary(r: Roles, guide_id: int = 1, raise_by: int = 5000):
    """UPDATE guides SET salary = salary + n WHERE guide_id = k."""
    from sitelens.jobs.upsert import update_where
    return update_where(r.guides, F.col("guide_id") == guide_id,
                        {"salary": (F.col("salary") + raise_by).cast("decimal(10,2)")})


@query("B14C", "delete_booking", "SELECT * FROM bookings WHERE NOT COALESCE(booking_id = 2, FALSE)")
def delete_booking(r: Roles, booking_id: int = 2):
    """DELETE FROM bookings WHERE booking_id = k (table minus the row)."""
    from sitelens.jobs.upsert import delete_where
    return delete_where(r.bookings, F.col("booking_id") == booking_id)


@query("B14D", "delete_past_events",
       "SELECT * FROM evts WHERE NOT COALESCE(event_date < DATE '2024-01-15', FALSE)")
def delete_past_events(r: Roles):
    """DELETE FROM events WHERE event_date < as_of."""
    from sitelens.jobs.upsert import delete_where
    return delete_where(r.evts, F.col("event_date") < day_lit(r.as_of_events))


@query("B15", "alter_guides", """
SELECT guide_id, full_name, language, specialization, salary, CAST(0 AS INT) AS years_of_experience FROM guides""")
def alter_guides(r: Roles):
    """ADD experience_years INT DEFAULT 0, then RENAME it to years_of_experience (M5)."""
    from sitelens.jobs.schema import add_column, rename_column
    return rename_column(add_column(r.guides, "experience_years", "int", 0), "experience_years", "years_of_experience")


@query("B15B", "retype_and_drop_columns", """
SELECT visitor_id, full_name, email, strftime(created_at, '%Y-%m-%d') AS created_at,
       TRY_CAST(phone AS INTEGER) AS phone FROM visitors""")
def retype_and_drop_columns(r: Roles):
    """MODIFY created_at to text and phone to INT (what does not fit is NULL), then DROP nationality (M5)."""
    from sitelens.jobs.schema import drop_column, modify_column
    return drop_column(modify_column(modify_column(r.visitors, "created_at", "string"), "phone", "int"), "nationality")
