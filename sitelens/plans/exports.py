"""Export frames (K1, K2, K3) and full-text queries (F8) of the catalogue.

The registered functions return the exact frame each export writes; call
``sitelens.sources.io.export_csv`` / ``write_json`` on it to produce files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import excerpt
from sitelens.operators.aggs import per_key
from sitelens.operators.joins import lookup
from sitelens.operators.text_index import TextIndex
from sitelens.operators.text_search import match_rows
from sitelens.plans.listings import site_search
from sitelens.plans.registry import query
from sitelens.session import checkpoint_dir
from sitelens.sources.io import export_csv, write_json
from sitelens.sources.roles import Roles


@query("K1A", "export_sites", """
SELECT site_id, name, location, type, ticket_price, unesco_status, created_at FROM sites""")
def export_sites_frame(r: Roles):
    """CSV export: sites."""
    return r.sites.select("site_id", "name", "location", "type", "ticket_price", "unesco_status", "created_at")


@query("K1B", "export_bookings", """
SELECT b.booking_id, v.full_name AS visitor_name, s.name AS site_name, b.no_of_tickets,
       b.booked_ticket_price AS total_price, b.payment_status, b.booking_date
FROM bookings b LEFT JOIN visitors v ON b.visitor_id = v.visitor_id LEFT JOIN sites s ON b.site_id = s.site_id""")
def export_bookings_frame(r: Roles):
    """CSV export: bookings with visitor and site names."""
    b = lookup(r.bookings, r.visitors, "visitor_id", "visitor_id", {"full_name": "visitor_name"})
    b = lookup(b, r.sites, "site_id", "site_id", {"name": "site_name"}, salt_by="booking_id")
    return b.select("booking_id", "visitor_name", "site_name", "no_of_tickets",
                    F.col("booked_ticket_price").alias("total_price"), "payment_status", "booking_date")


@query("K1C", "export_payments", """
SELECT p.booking_id, p.attempt_no, v.full_name AS visitor_name, s.name AS site_name, p.amount, p.method, p.status,
       p.paid_at AS payment_date
FROM payments p LEFT JOIN bookings b ON p.booking_id = b.booking_id
LEFT JOIN visitors v ON b.visitor_id = v.visitor_id LEFT JOIN sites s ON b.site_id = s.site_id""")
def export_payments_frame(r: Roles):
    """CSV export: payments with visitor and site names."""
    b = r.bookings.select(F.col("booking_id").alias("__bid"), "visitor_id", "site_id")
    p = r.payments.join(b, F.col("booking_id") == F.col("__bid"), "left").drop("__bid")
    p = lookup(p, r.visitors, "visitor_id", "visitor_id", {"full_name": "visitor_name"})
    p = lookup(p, r.sites, "site_id", "site_id", {"name": "site_name"}, salt_by="booking_id")
    return p.select("booking_id", "attempt_no", "visitor_name", "site_name", "amount", "method", "status",
                    F.col("paid_at").alias("payment_date"))


@query("K1D", "export_guides", """
SELECT g.guide_id, g.full_name AS name, g.language, COUNT(a.assign_id) AS total_assignments
FROM guides g LEFT JOIN assignments a ON g.guide_id = a.guide_id GROUP BY g.guide_id, g.full_name, g.language""")
def export_guides_frame(r: Roles):
    """CSV export: guides with assignment counts (phone / experience_years only when present)."""
    optional = [c for c in ("phone", "experience_years") if c in r.guides.columns]
    per = per_key(r.assignments, "guide_id", [F.count("assign_id").alias("total_assignments")])
    return (r.guides.select("guide_id", F.col("full_name").alias("name"), *optional, "language")
            .join(per, "guide_id", "left").fillna({"total_assignments": 0}))


@query("K2", "export_sites_filtered", """
SELECT site_id, name, location, type, ticket_price, unesco_status, created_at, description, opening_hours FROM sites
WHERE ticket_price >= 950 AND unesco_status = 'Tentative' ORDER BY ticket_price DESC, site_id""")
def export_sites_filtered(r: Roles, sort: str = "desc", **filters):
    """Filtered, ordered site export: the admin listing's frame (L2) in its sort order."""
    filters = filters or {"min_price": 950, "unesco": "Tentative"}
    lst = site_search(r, sort, admin=True, extra=("description", "opening_hours"), **filters)
    return lst.frame.orderBy(*lst.order)


def export_all(r: Roles, folder: str) -> dict[str, str]:
    """K1: write the four CSV exports under ``folder``."""
    return {name: export_csv(fn(r), f"{folder.rstrip('/')}/{name}")
            for name, fn in (("sites", export_sites_frame), ("bookings", export_bookings_frame),
                             ("payments", export_payments_frame), ("guides", export_guides_frame))}


def write_api_series(r: Roles, folder: str) -> dict[str, str]:
    """K3: the five JSON API series (D21) as JSON-lines folders."""
    from sitelens.plans import dashboard as d
    series = {"bookings_per_month": d.api_bookings_per_month, "revenue_by_method": d.api_revenue_by_method,
              "guide_workload": d.api_guide_workload, "review_distribution": d.api_review_distribution,
              "payment_status": d.api_payment_status}
    return {k: write_json(fn(r), f"{folder.rstrip('/')}/{k}") for k, fn in series.items()}


# ---------------------------------------------------------------- F8 over the documents table

def _documents(r: Roles) -> DataFrame:
    docs = r.extra.get("documents")
    if docs is None:
        raise KeyError("roles were built without the documents table")
    return docs


F8_QUERY = "+with -the"
_INDEXES: dict[tuple[str, str], TextIndex] = {}


@query("F8", "fulltext_documents", r"""
SELECT doc_id, lang, source, n_chars FROM documents
WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), 'with')
  AND NOT list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), 'the')""")
def fulltext_documents(r: Roles, q: str = F8_QUERY):
    """Boolean full-text match over whole document texts (row predicate plan)."""
    return match_rows(_documents(r), "text", q).select("doc_id", "lang", "source", "n_chars")


@query("F8I", "fulltext_documents_index", r"""
SELECT doc_id, lang, source, n_chars FROM documents
WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), 'with')
  AND NOT list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), 'the')""")
def fulltext_documents_index(r: Roles, q: str = F8_QUERY):
    """Same query answered from the stored inverted index, which is written once per table and session."""
    docs = _documents(r)
    key = (r.spark.sparkContext.applicationId, r.extra.get("sf_dir"))
    index = _INDEXES.get(key)
    if index is None:
        index = TextIndex(r.spark, f"{checkpoint_dir(r.spark)}/text-index-{uuid.uuid4().hex}")
        index.add(docs, "doc_id", "text")
        if key[1] is not None:                        # a table without a name is indexed for this query alone
            _INDEXES[key] = index
    return index.rows(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id", q)


@query("F8S", "fulltext_site_descriptions", r"""
SELECT site_id, name, LEFT(description, 120) AS excerpt FROM sites
WHERE list_contains(regexp_split_to_array(lower(description), '[^\p{L}\p{N}_]+'), 'small')
  AND NOT list_contains(regexp_split_to_array(lower(description), '[^\p{L}\p{N}_]+'), 'economy')""")
def fulltext_site_descriptions(r: Roles, q: str = "+small -economy"):
    """Boolean full-text over site descriptions with a required and an excluded word."""
    return match_rows(r.sites, "description", q).select("site_id", "name", excerpt("description", 120).alias("excerpt"))
