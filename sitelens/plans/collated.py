"""Catalogue queries over collated roles, as a search without case and accents gives them.

The entries write every second row of each table in capitals with accents and search
with words in other case.  Under the collation the answers are those of the plain
queries over the plain tables, up to case and accents, so each entry folds its texts
and its oracle is the plain query's with folded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.plans.registry import REGISTRY, QuerySpec
from sitelens.sources.roles import Roles

ROW_KEYS = {"sites": "site_id", "evts": "event_id", "visitors": "visitor_id", "bookings": "booking_id",
            "payments": "payment_id", "guides": "guide_id", "assignments": "assign_id", "reviews": "review_id"}


def varied(r: Roles) -> Roles:
    """Every second row's texts in capitals, with accents on E and O."""
    def change(df: DataFrame, key: str) -> DataFrame:
        odd = F.col(key) % 2 == 1
        return df.select(*[F.when(odd, F.translate(F.upper(f.name), "EO", "ÉÖ")).otherwise(F.col(f.name)).alias(f.name)
                           if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])
    return r.with_tables(**{n: change(df, ROW_KEYS[n]) for n, df in r.as_dict().items()})


def folded(df: DataFrame) -> DataFrame:
    """Texts in lower case without those accents, under the default collation."""
    return df.select(*[F.translate(F.lower(F.collate(f"`{f.name}`", "UTF8_BINARY")), "éö", "eo").alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def _entry(name: str, texts: list[str], params: dict | None = None, literals: dict[str, str] | None = None,
           key: str = "") -> None:
    """Register ``name`` over collated roles; ``texts`` are the answer's text columns."""
    base = REGISTRY[name]
    sql = base.sql.strip()
    for old, new in (literals or {}).items():
        if old not in sql:
            raise ValueError(f"{name}: the oracle has no {old!r}")
        sql = sql.replace(old, new)
    if sql.startswith(","):
        raise ValueError(f"{name}: the oracle has tables of its own")
    fold = ", ".join(f"LOWER({c}) AS {c}" for c in texts)
    all_params = base.params | (params or {})

    def fn(r: Roles, **more) -> DataFrame:
        return folded(base.fn(varied(r).collated(), **(all_params | more)))
    spec = QuerySpec(f"N1-{base.qid}", key or base.key, fn, f"SELECT * REPLACE ({fold}) FROM ({sql}) t",
                     f"{base.title} Without case and accents.")
    REGISTRY[spec.name] = spec


SITE = ["name", "location", "type", "unesco_status"]
_entry("l1_site_search_page", SITE, {"name": "WIDGÉT", "type_": "économy"},
       {"FROM sites\n": "FROM sites WHERE name LIKE '%widget%' AND type = 'ECONOMY'\n"})
_entry("l2_site_admin_page", SITE, {"type_": "promo"}, {"ticket_price >= 950": "ticket_price >= 950 AND type = 'PROMO'"})
_entry("l3c_event_list_by_capacity", ["name", "site_name", "unesco_status"], {"q": "VIEW"})
_entry("l4_guide_list", ["full_name", "language", "specialization", "status"], {"language": "nation_9"},
       {"BETWEEN 0 AND 5000": "BETWEEN 0 AND 5000 AND g.language = 'NATION_9'"})
_entry("l5_assignment_list", ["guide_name", "shift_time", "target_name"])
_entry("l6_payment_list_page", ["method", "status", "visitor", "target_name"])
_entry("l7_visitor_list", ["full_name", "nationality", "email", "phone"], {"q": "CUSTÖMER#00000001"},
       {"WHERE COALESCE(b.n, 0)": "WHERE v.full_name LIKE '%Customer#00000001%' AND COALESCE(b.n, 0)"})
_entry("l8_visitor_bookings_list", ["payment_status", "target_name", "target_kind"], {"target": "WIDGET"},
       {"WHERE b.payment_status": "WHERE COALESCE(s.name, e.name) LIKE '%widget%' AND b.payment_status"})
_entry("l8r_visitor_reviews_list", ["comment", "site_name", "event_name"], {"keyword": "CLICK"})
_entry("c_x02_count_sites_by_location", ["location"])
_entry("c_x06_sites_with_bookings_in", ["name"])
_entry("c_x09_union_sites_and_events_names", ["name"])
