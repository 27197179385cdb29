"""Parametric listings L1..L8: filter builder + allow-listed sort + page.

A listing is one filtered DataFrame; the page, the total count and the
filtered stats are three small actions on it.  Sorting always ends with the
table key so pages are stable; sort columns come from an allow-list, never
from raw request text.  Pages use ``OFFSET`` + ``LIMIT`` (a bounded
TakeOrdered of offset + size rows) or, for deep pages, key-set paging
(``Listing.page_after``: rows after the last sort-key tuple).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import contains_like, day_lit, ravg_int, ts_lit
from sitelens.operators.aggs import branch_aggregate
from sitelens.operators.aggs import capped
from sitelens.operators.joins import lookup, resolve_target, target_names
from sitelens.plans.registry import query
from sitelens.plans.sqlfrag import s_ravgi
from sitelens.sources.roles import Roles

DATE_RE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
# The UNESCO status domain accepted by the site filters.
UNESCO_VALUES = ["None", "Tentative", "World Heritage"]


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = 6

    @property
    def offset(self) -> int:
        return max(self.number - 1, 0) * self.size


def _after(c: Column, v, asc: bool) -> Column:
    """Rows strictly after value ``v`` in one sort column (ASC NULLS FIRST / DESC NULLS LAST)."""
    if asc:
        return c.isNotNull() if v is None else c > F.lit(v)
    return F.lit(False) if v is None else (c < F.lit(v)) | c.isNull()


def _same(c: Column, v) -> Column:
    return c.isNull() if v is None else c == F.lit(v)


@dataclass(frozen=True)
class Listing:
    """A filtered frame plus its sort (column, ascending) pairs; pages and counts derive from it."""

    frame: DataFrame
    sort: list[tuple[str, bool]] = field(default_factory=list)

    @property
    def order(self) -> list[Column]:
        return [F.asc(c) if a else F.desc(c) for c, a in self.sort]

    def page(self, page: Page) -> DataFrame:
        """OFFSET paging: a bounded TakeOrdered of offset + size rows."""
        return self.frame.orderBy(*self.order).offset(page.offset).limit(page.size)

    def page_after(self, last: tuple | None, size: int) -> DataFrame:
        """Key-set paging: the ``size`` rows after the sort-key tuple ``last``.

        For deep pages: the predicate prunes everything before the key, so the
        cost does not grow with the page number (OFFSET has to rank them all).
        """
        f = self.frame
        if last is not None:
            cond = F.lit(False)
            prefix = F.lit(True)
            for (c, asc), v in zip(self.sort, last):
                cond = cond | (prefix & _after(F.col(c), v, asc))
                prefix = prefix & _same(F.col(c), v)
            f = f.where(cond)
        return f.orderBy(*self.order).limit(size)

    def count(self, page_size: int) -> DataFrame:
        """Total rows and pages as a one-row DataFrame."""
        return self.frame.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
            "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / F.lit(page_size))).cast("bigint"))


def _and(preds: list[Column]) -> Column:
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out


# ---------------------------------------------------------------- L1 / L2 sites

def site_filters(r: Roles, name: str | None = None, location: str | None = None, type_: str | None = None,
                 unesco: str | None = None, min_price: float | None = None, max_price: float | None = None,
                 clamp: bool = False) -> list[Column]:
    preds: list[Column] = []
    if name:
        preds.append(contains_like("name", name))
    if location:
        preds.append(F.col("location") == location)
    if type_:
        preds.append(F.col("type") == type_)
    if unesco and unesco in UNESCO_VALUES:
        preds.append(F.col("unesco_status") == unesco)
    if clamp and (min_price is not None or max_price is not None):
        rng = r.sites.agg(F.min("ticket_price").alias("lo"), F.max("ticket_price").alias("hi"))
        lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
        if min_price is not None:
            preds.append(F.col("ticket_price") >= F.greatest(F.lit(min_price), lo))
        if max_price is not None:
            preds.append(F.col("ticket_price") <= F.least(F.lit(max_price), hi))
    else:
        if min_price is not None:
            preds.append(F.col("ticket_price") >= min_price)
        if max_price is not None:
            preds.append(F.col("ticket_price") <= max_price)
    return preds


def site_search(r: Roles, sort: str = "", admin: bool = False, extra: tuple[str, ...] = (), **filters) -> Listing:
    """L1 (public, prices clamped to the data range) / L2 (admin, default newest first); ``extra``: more site columns."""
    cols = ["site_id", "name", "location", "type", "ticket_price", "unesco_status"] + (["created_at"] if admin else [])
    cols += extra
    f = r.sites.where(_and(site_filters(r, clamp=not admin, **filters))).select(*cols)
    order = {"asc": [("ticket_price", True)], "desc": [("ticket_price", False)], "name": [("name", True)],
             "created": [("created_at", False)]}.get(sort or ("created" if admin else "name"), [("name", True)])
    return Listing(f, order + [("site_id", True)])


@query("L1", "site_search_page", """
SELECT site_id, name, location, type, ticket_price, unesco_status FROM sites
ORDER BY name, site_id LIMIT 6 OFFSET 0""")
def site_search_page(r: Roles, page: int = 1, size: int = 6, sort: str = "", **filters):
    """Public site search: first page (6 rows) by name."""
    return site_search(r, sort, **filters).page(Page(page, size))


@query("L1P", "site_search_clamped", """
SELECT site_id, name, location, type, ticket_price, unesco_status FROM sites
WHERE ticket_price >= GREATEST(-5, (SELECT MIN(ticket_price) FROM sites))
  AND ticket_price <= LEAST(100000, (SELECT MAX(ticket_price) FROM sites)) AND type = 'PROMO'
ORDER BY ticket_price DESC, site_id LIMIT 6 OFFSET 6""")
def site_search_clamped(r: Roles, page: int = 2, size: int = 6, min_price: float = -5, max_price: float = 100000,
                        type_: str = "PROMO"):
    """Public site search: bounds beyond the data's prices are clamped to them; page 2, dearest first."""
    return site_search(r, "desc", min_price=min_price, max_price=max_price, type_=type_).page(Page(page, size))


@query("L1C", "site_search_count", """
SELECT COUNT(*) AS total_rows, CAST(GREATEST(1, CEIL(COUNT(*) / 6.0)) AS BIGINT) AS total_pages FROM sites""")
def site_search_count(r: Roles, size: int = 6, **filters):
    """Public site search: total rows and pages."""
    return site_search(r, **filters).count(size)


@query("L2", "site_admin_page", """
SELECT site_id, name, location, type, ticket_price, unesco_status, created_at FROM sites
WHERE ticket_price >= 950 ORDER BY created_at DESC, site_id LIMIT 5 OFFSET 5""")
def site_admin_page(r: Roles, page: int = 2, size: int = 5, sort: str = "", min_price: float | None = 950,
                    **filters):
    """Admin site list: page 2 (5 rows) of sites priced ≥ 950, newest first."""
    return site_search(r, sort, admin=True, min_price=min_price, **filters).page(Page(page, size))


@query("L2S", "site_admin_stats", """
SELECT COUNT(*) AS total, MIN(ticket_price) AS min_price, MAX(ticket_price) AS max_price,
       CAST(AVG(ticket_price) AS DECIMAL(14,6)) AS avg_price FROM sites WHERE ticket_price >= 950""")
def site_admin_stats(r: Roles, min_price: float | None = 950, **filters):
    """Filtered stats of the admin list (count, min, max, avg)."""
    f = site_search(r, admin=True, min_price=min_price, **filters).frame
    return f.agg(F.count(F.lit(1)).alias("total"), F.min("ticket_price").alias("min_price"),
                 F.max("ticket_price").alias("max_price"), F.avg("ticket_price").cast("decimal(14,6)").alias("avg_price"))


# ---------------------------------------------------------------- L3 events

EVENT_SORTS = {"date_desc": ("event_date", False), "date_asc": ("event_date", True),
               "price_asc": ("ticket_price", True), "price_desc": ("ticket_price", False), "name": ("name", True), "name_desc": ("name", False),
               "capacity_asc": ("capacity", True), "capacity_desc": ("capacity", False),
               "site_asc": ("site_name", True), "site_desc": ("site_name", False)}


def _sort(allowed: dict[str, tuple[str, bool]], key: str, default: str) -> list[tuple[str, bool]]:
    """Allow-listed sort: unknown keys fall back to the default."""
    return [allowed.get(key, allowed[default])]


def event_list(r: Roles, q: str | None = None, site_id: int | None = None, unesco: str | None = None,
               date_from: str | None = None, date_to: str | None = None, min_price: float | None = None,
               max_price: float | None = None, sort: str = "date_desc") -> Listing:
    """L3: events joined with their site; malformed dates ignored, reversed prices swapped."""
    e = r.evts
    preds: list[Column] = []
    if q:
        preds.append(contains_like("name", q) | contains_like("description", q))
    if site_id is not None:
        preds.append(F.col("site_id") == site_id)
    if date_from and DATE_RE.match(date_from):
        preds.append(F.col("event_date") >= day_lit(date_from))
    if date_to and DATE_RE.match(date_to):
        preds.append(F.col("event_date") <= day_lit(date_to))
    if min_price is not None and max_price is not None and min_price > max_price:
        min_price, max_price = max_price, min_price
    if min_price is not None:
        preds.append(F.col("ticket_price") >= min_price)
    if max_price is not None:
        preds.append(F.col("ticket_price") <= max_price)
    s = r.sites.select(F.col("site_id").alias("__sid"), F.col("name").alias("site_name"), "unesco_status")
    if unesco:
        s = s.where(F.col("unesco_status") == unesco)
    f = e.where(_and(preds)).join(s, F.col("site_id") == F.col("__sid")).drop("__sid")
    return Listing(f.select("event_id", "site_id", "name", "event_date", "ticket_price", "capacity", "site_name",
                            "unesco_status"), _sort(EVENT_SORTS, sort, "date_desc") + [("event_id", True)])


@query("L3", "event_list_page", """
SELECT e.event_id, e.site_id, e.name, e.event_date, e.ticket_price, e.capacity, s.name AS site_name, s.unesco_status
FROM evts e JOIN sites s ON e.site_id = s.site_id
WHERE e.event_date >= DATE '2024-01-10' AND e.event_date <= DATE '2024-01-20'
  AND e.ticket_price >= 10 AND e.ticket_price <= 400
ORDER BY e.event_date DESC, e.event_id LIMIT 10 OFFSET 10""")
def event_list_page(r: Roles, page: int = 2, size: int = 10):
    """Event list: 10-day window, price range given reversed (swapped), page 2."""
    lst = event_list(r, date_from="2024-01-10", date_to="2024-01-20", min_price=400, max_price=10)
    return lst.page(Page(page, size))


@query("L3C", "event_list_by_capacity", """
SELECT e.event_id, e.site_id, e.name, e.event_date, e.ticket_price, e.capacity, s.name AS site_name, s.unesco_status
FROM evts e JOIN sites s ON e.site_id = s.site_id
WHERE e.name LIKE '%view%' OR e.description LIKE '%view%'
ORDER BY e.capacity DESC, e.event_id LIMIT 10""")
def event_list_by_capacity(r: Roles, q: str = "view", page: int = 1, size: int = 10):
    """Event list of a word: largest capacity first."""
    return event_list(r, q=q, sort="capacity_desc").page(Page(page, size))


@query("L3N", "event_list_by_site_name", """
SELECT e.event_id, e.site_id, e.name, e.event_date, e.ticket_price, e.capacity, s.name AS site_name, s.unesco_status
FROM evts e JOIN sites s ON e.site_id = s.site_id WHERE s.unesco_status = 'Tentative'
ORDER BY s.name, e.event_id LIMIT 10 OFFSET 10""")
def event_list_by_site_name(r: Roles, unesco: str = "Tentative", page: int = 2, size: int = 10):
    """Event list of a UNESCO status by the site's name, page 2."""
    return event_list(r, unesco=unesco, sort="site_asc").page(Page(page, size))


# ---------------------------------------------------------------- L4 guides

def guide_list(r: Roles, q: str | None = None, language: str | None = None, assigned: str | None = None,
               min_salary: float | None = None, max_salary: float | None = None) -> Listing:
    """L4: one row per guide with an Assigned/Unassigned flag (semi/anti, no fan-out)."""
    g = r.guides
    preds: list[Column] = []
    if q:
        preds.append(contains_like("full_name", q) | contains_like("specialization", q))
    if language:
        preds.append(F.col("language") == language)
    if min_salary is not None and max_salary is not None:
        preds.append(F.col("salary").between(min_salary, max_salary))
    g = g.where(_and(preds))
    has = r.assignments.select(F.col("guide_id").alias("__g")).distinct().withColumn("__a", F.lit(True))
    g = g.join(has, F.col("guide_id") == F.col("__g"), "left").drop("__g")
    g = g.withColumn("status", F.when(F.col("__a"), "Assigned").otherwise("Unassigned")).drop("__a")
    if assigned == "yes":
        g = g.where(F.col("status") == "Assigned")
    elif assigned == "no":
        g = g.where(F.col("status") == "Unassigned")
    return Listing(g, [("full_name", True), ("guide_id", True)])


@query("L4", "guide_list", """
SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM assignments a WHERE a.guide_id = g.guide_id)
                 THEN 'Assigned' ELSE 'Unassigned' END AS status
FROM guides g WHERE g.salary BETWEEN 0 AND 5000""")
def guide_list_query(r: Roles, min_salary: float | None = 0, max_salary: float | None = 5000, **kw):
    """Guide list with salary between both bounds (0 is a bound, not 'no filter')."""
    return guide_list(r, min_salary=min_salary, max_salary=max_salary, **kw).frame


# ---------------------------------------------------------------- L5 assignments

@query("L5", "assignment_list", """
SELECT a.assign_id, a.guide_id, g.full_name AS guide_name, a.site_id, a.event_id, a.shift_time,
       COALESCE(s.name, e.name) AS target_name
FROM assignments a JOIN guides g ON a.guide_id = g.guide_id LEFT JOIN sites s ON a.site_id = s.site_id
LEFT JOIN evts e ON a.event_id = e.event_id""")
def assignment_list(r: Roles, guide_id: int | None = None, site_id: int | None = None,
                    event_id: int | None = None):
    """Assignments with guide and polymorphic target, ordered by target then guide."""
    a = r.assignments
    for c, v in (("guide_id", guide_id), ("site_id", site_id), ("event_id", event_id)):
        if v is not None:
            a = a.where(F.col(c) == v)
    a = a.join(r.guides.select("guide_id", F.col("full_name").alias("guide_name")), "guide_id")
    a = resolve_target(a, r.sites, r.evts, kind=None, salt_by="assign_id")
    return (a.select("assign_id", "guide_id", "guide_name", "site_id", "event_id", "shift_time", "target_name")
            .orderBy("target_name", "guide_name", "assign_id"))


# ---------------------------------------------------------------- L6 payments

def payment_list(r: Roles, q: str | None = None, method: str | None = None, status: str | None = None,
                 site: str | None = None, date_from: str | None = None, date_to: str | None = None,
                 min_amount: float | None = None, max_amount: float | None = None) -> Listing:
    """Payments with visitor and target; date range half-open [from, to + 1 day)."""
    p = r.payments
    preds: list[Column] = []
    if method:
        preds.append(F.col("method") == method)
    if status:
        preds.append(F.col("status") == status)
    if date_from and date_to and DATE_RE.match(date_from) and DATE_RE.match(date_to):
        preds.append((F.col("paid_at") >= ts_lit(date_from)) &
                     (F.col("paid_at") < F.date_add(day_lit(date_to), 1).cast("timestamp_ntz")))
    if min_amount is not None:
        preds.append(F.col("amount") >= min_amount)
    if max_amount is not None:
        preds.append(F.col("amount") <= max_amount)
    p = p.where(_and(preds))
    b = r.bookings.select("booking_id", "visitor_id", "site_id", "event_id")
    b = b.join(r.visitors.select("visitor_id", F.col("full_name").alias("visitor")), "visitor_id")
    j = p.join(resolve_target(b, r.sites, r.evts, salt_by="booking_id"), "booking_id")
    if q:
        j = j.where(contains_like(F.col("visitor_id").cast("string"), q) |
                    (F.col("target_kind") == "site") & contains_like("target_name", q))
    if site:
        j = j.where((F.col("target_kind") == "site") & contains_like("target_name", site))
    return Listing(j, [("paid_at", False), ("booking_id", True), ("attempt_no", True), ("acquirer_id", True),
                       ("amount", True)])


@query("L6", "payment_list_page", """
SELECT p.booking_id, p.attempt_no, p.acquirer_id, p.amount, p.method, p.status, p.paid_at, v.full_name AS visitor,
       COALESCE(s.name, e.name) AS target_name
FROM payments p JOIN bookings b ON p.booking_id = b.booking_id JOIN visitors v ON b.visitor_id = v.visitor_id
LEFT JOIN sites s ON b.site_id = s.site_id LEFT JOIN evts e ON b.event_id = e.event_id
WHERE p.method = 'card' AND p.paid_at >= TIMESTAMP '1998-01-01' AND p.paid_at < TIMESTAMP '1998-07-01'
ORDER BY p.paid_at DESC, p.booking_id, p.attempt_no, p.acquirer_id, p.amount, p.method, p.status""")
def payment_list_page(r: Roles, k: int | None = None):
    """Payment list: card payments in the first half of 1998, newest first."""
    lst = payment_list(r, method="card", date_from="1998-01-01", date_to="1998-06-30")
    return (lst.frame.orderBy(*lst.order, "method", "status").transform(capped, k)
            .select("booking_id", "attempt_no", "acquirer_id", "amount", "method", "status", "paid_at", "visitor",
                    "target_name"))


# ---------------------------------------------------------------- L7 visitors

VISITOR_SORTS = {"created_at", "full_name", "email", "total_bookings", "avg_rating", "total_reviews"}


def _norm_range(lo, hi, cast, lower=0.0, upper=None):
    lo = None if lo is None else max(cast(lo), lower)
    hi = None if hi is None else max(cast(hi), lower)
    if lo is not None and hi is not None and lo > hi:
        lo, hi = hi, lo
    if upper is not None:
        lo = None if lo is None else min(lo, upper)
        hi = None if hi is None else min(hi, upper)
    return lo, hi


def visitor_list(r: Roles, name: str | None = None, q: str | None = None, nationality: str | None = None,
                 joined_from: str | None = None, min_bookings=None, max_bookings=None, min_rating=None,
                 max_rating=None, has_booking: str = "", has_review: str = "", sort: str = "created_at",
                 order: str = "DESC") -> Listing:
    """Visitors with bookings/rating/review aggregates and post-aggregate filters.

    Bookings and reviews are aggregated separately per visitor (A6), which is
    what COUNT(DISTINCT) over the reference's double LEFT JOIN computes.
    """
    v = r.visitors
    preds: list[Column] = []
    if name:
        preds.append(contains_like("full_name", name))
    if q:
        preds.append(contains_like("full_name", q) | contains_like("email", q))
    if nationality:
        preds.append(F.col("nationality") == nationality)
    if joined_from and DATE_RE.match(joined_from):
        preds.append(F.col("created_at").cast("date") >= day_lit(joined_from))
    v = v.where(_and(preds))
    out = branch_aggregate(v, "visitor_id",
                           [(r.bookings, "visitor_id", [F.count(F.lit(1)).alias("total_bookings")]),
                            (r.reviews, "visitor_id", [ravg_int("rating").alias("avg_rating"),
                                                       F.count(F.lit(1)).alias("total_reviews")])],
                           fill={"total_bookings": 0, "total_reviews": 0})
    minb, maxb = _norm_range(None if min_bookings is None else math.floor(float(min_bookings)),
                             None if max_bookings is None else math.ceil(float(max_bookings)), int, 0)
    minr, maxr = _norm_range(None if min_rating is None else round(float(min_rating), 1),
                             None if max_rating is None else round(float(max_rating), 1), float, 0.0, 5.0)
    having: list[Column] = []
    if has_booking == "yes":
        having.append(F.col("total_bookings") > 0)
    if has_booking == "no":
        having.append(F.col("total_bookings") == 0)
    if has_review == "yes":
        having.append(F.col("total_reviews") > 0)
    if has_review == "no":
        having.append(F.col("total_reviews") == 0)
    if minb is not None:
        having.append(F.col("total_bookings") >= minb)
    if maxb is not None:
        having.append(F.col("total_bookings") <= maxb)
    rating0 = F.coalesce(F.col("avg_rating"), F.lit(0))
    if minr is not None:
        having.append(rating0 >= minr)
    if maxr is not None:
        having.append(rating0 <= maxr)
    out = out.where(_and(having))
    s = sort if sort in VISITOR_SORTS else "created_at"
    return Listing(out, [(s, order == "ASC"), ("visitor_id", True)])


@query("L7", "visitor_list", f"""
SELECT v.visitor_id, v.full_name, v.nationality, v.email, v.phone, v.created_at,
       COALESCE(b.n, 0) AS total_bookings, rv.avg_rating, COALESCE(rv.n, 0) AS total_reviews
FROM visitors v
LEFT JOIN (SELECT visitor_id, COUNT(*) AS n FROM bookings GROUP BY visitor_id) b ON b.visitor_id = v.visitor_id
LEFT JOIN (SELECT visitor_id, {s_ravgi('rating')} AS avg_rating, COUNT(*) AS n FROM reviews GROUP BY visitor_id) rv
  ON rv.visitor_id = v.visitor_id
WHERE COALESCE(b.n, 0) >= 5 AND COALESCE(rv.avg_rating, 0) >= 2.5""")
def visitor_list_query(r: Roles, min_bookings=5, min_rating=2.5, **kw):
    """Visitor list with HAVING on bookings and rating (NULL rating as 0)."""
    return visitor_list(r, min_bookings=min_bookings, min_rating=min_rating, **kw).frame


# ---------------------------------------------------------------- L8 visitor details

BOOKING_SORTS = {"date_desc": ("booking_date", False), "date_asc": ("booking_date", True),
                 "price_desc": ("booked_ticket_price", False), "price_asc": ("booked_ticket_price", True)}


def visitor_bookings_list(r: Roles, visitor_id: int | None = None, status: str | None = None,
                          date_from: str | None = None, date_to: str | None = None, target: str | None = None,
                          sort: str = "date_desc", midnight_cut: bool = False) -> Listing:
    """L8 bookings: status, dates (half-open unless ``midnight_cut``), target text; allow-listed sort."""
    b = r.bookings
    preds: list[Column] = []
    if visitor_id is not None:
        preds.append(F.col("visitor_id") == visitor_id)
    if status:
        preds.append(F.col("payment_status") == status)
    if date_from and DATE_RE.match(date_from):
        preds.append(F.col("booking_date") >= ts_lit(date_from))
    if date_to and DATE_RE.match(date_to):
        end = ts_lit(date_to) if midnight_cut else F.date_add(day_lit(date_to), 1).cast("timestamp_ntz")
        preds.append(F.col("booking_date") <= end if midnight_cut else F.col("booking_date") < end)
    b = resolve_target(b.where(_and(preds)), r.sites, r.evts, salt_by="booking_id")
    if target:
        b = b.where(contains_like("target_name", target))
    return Listing(b, _sort(BOOKING_SORTS, sort, "date_desc") + [("booking_id", True)])


@query("L8", "visitor_bookings_list", """
SELECT b.*, COALESCE(s.name, e.name) AS target_name,
       CASE WHEN s.name IS NOT NULL THEN 'site' WHEN e.name IS NOT NULL THEN 'event' END AS target_kind
FROM bookings b LEFT JOIN sites s ON b.site_id = s.site_id LEFT JOIN evts e ON b.event_id = e.event_id
WHERE b.payment_status = 'paid' AND b.booking_date >= TIMESTAMP '2000-01-01'
  AND b.booking_date < TIMESTAMP '2001-01-01'""")
def visitor_bookings_list_query(r: Roles, status: str = "paid", date_from: str = "2000-01-01",
                                date_to: str = "2000-12-31", **kw):
    """Visitor-detail bookings: paid bookings in 2000 with their target (all visitors)."""
    return visitor_bookings_list(r, status=status, date_from=date_from, date_to=date_to, **kw).frame


PAYMENT_SORTS = {"paid_desc": ("paid_at", False), "paid_asc": ("paid_at", True),
                 "amount_desc": ("amount", False), "amount_asc": ("amount", True)}
REVIEW_SORTS = {"date_desc": ("review_date", False), "date_asc": ("review_date", True),
                "rating_desc": ("rating", False), "rating_asc": ("rating", True)}


def visitor_payments_list(r: Roles, visitor_id: int | None = None, status: str | None = None,
                          method: str | None = None, min_amount: float | None = None,
                          max_amount: float | None = None, sort: str = "paid_desc") -> Listing:
    """L8 payments: status, method, amount range; allow-listed sort (raw ORDER BY text is not accepted)."""
    b = r.bookings.select("booking_id", "visitor_id")
    if visitor_id is not None:
        b = b.where(F.col("visitor_id") == visitor_id)
    preds: list[Column] = []
    if status:
        preds.append(F.col("status") == status)
    if method:
        preds.append(F.col("method") == method)
    if min_amount is not None:
        preds.append(F.col("amount") >= min_amount)
    if max_amount is not None:
        preds.append(F.col("amount") <= max_amount)
    p = r.payments.where(_and(preds)).join(b, "booking_id")
    return Listing(p, _sort(PAYMENT_SORTS, sort, "paid_desc") +
                   [(c, True) for c in ("booking_id", "attempt_no", "acquirer_id", "amount", "method", "status")])


@query("L8P", "visitor_payments_list", """
SELECT p.*, b.visitor_id FROM payments p JOIN bookings b ON p.booking_id = b.booking_id
WHERE p.status = 'successful' AND p.method = 'card' AND p.amount >= 1000 AND p.amount <= 50000""")
def visitor_payments_list_query(r: Roles, status: str = "successful", method: str = "card",
                                min_amount: float = 1000, max_amount: float = 50000, **kw):
    """Visitor-detail payments: successful card payments between two amounts (all visitors)."""
    return visitor_payments_list(r, status=status, method=method, min_amount=min_amount,
                                 max_amount=max_amount, **kw).frame


def visitor_reviews_list(r: Roles, visitor_id: int | None = None, rating: int | None = None,
                         keyword: str | None = None, sort: str = "date_desc") -> Listing:
    """L8 reviews: exact rating, keyword on the comment or the site/event name; allow-listed sort."""
    rv = r.reviews
    if visitor_id is not None:
        rv = rv.where(F.col("visitor_id") == visitor_id)
    if rating:
        rv = rv.where(F.col("rating") == rating)
    rv = target_names(rv, r.sites, r.evts, salt_by="review_id")
    if keyword:
        rv = rv.where(F.coalesce(contains_like("comment", keyword), F.lit(False))
                      | F.coalesce(contains_like("site_name", keyword), F.lit(False))
                      | F.coalesce(contains_like("event_name", keyword), F.lit(False)))
    return Listing(rv, _sort(REVIEW_SORTS, sort, "date_desc") + [("review_id", True)])


@query("L8R", "visitor_reviews_list", """
SELECT r.*, s.name AS site_name, e.name AS event_name FROM reviews r
LEFT JOIN sites s ON r.site_id = s.site_id LEFT JOIN evts e ON r.event_id = e.event_id
WHERE r.rating = 4 AND (r.comment LIKE '%click%' OR s.name LIKE '%click%' OR e.name LIKE '%click%')""")
def visitor_reviews_list_query(r: Roles, rating: int = 4, keyword: str = "click", **kw):
    """Visitor-detail reviews: rating 4 whose comment or target mentions a keyword (all visitors)."""
    return visitor_reviews_list(r, rating=rating, keyword=keyword, **kw).frame
