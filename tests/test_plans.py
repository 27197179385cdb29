"""Physical-plan checks: the plan shapes the design relies on."""

from __future__ import annotations

import re

import pytest

from sitelens.plans import REGISTRY
from sitelens.sources.roles import read_roles

BOUNDED_PRODUCTS = {"c_s21_cross_join_example", "c_e18_cross_join_example", "c_g16_guides_cross_join_demo",
                    "c_a17_cross_join_lang_site"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_unbounded_cartesian_or_nested_loop(roles):
    bad = {}
    for name, spec in REGISTRY.items():
        if name.startswith(("m", "t")):
            continue
        p = plan(spec.fn(roles))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in p]
        if hits and name not in BOUNDED_PRODUCTS:
            bad[name] = hits
    assert not bad


def test_bounded_products_limit_both_sides(roles):
    for name in BOUNDED_PRODUCTS:
        p = plan(REGISTRY[name].fn(roles))
        assert p.count("TakeOrderedAndProject") >= 2 or p.count("Limit") >= 2, name


@pytest.mark.parametrize("name", ["c_x17_view_sites_summary", "d24_site_page_aggregates", "c_x11_site_revenue"])
def test_children_aggregated_before_join(roles, name):
    """Fan-out safety: every child branch is a HashAggregate below the join that meets the parent."""
    p = plan(REGISTRY[name].fn(roles))
    assert "partial_count" in p or "partial_sum" in p
    # no COUNT(DISTINCT …) expansion is needed
    assert "Expand" not in p


def test_top_k_is_take_ordered(roles):
    p = plan(REGISTRY["c_x01_orderby_ticket_desc"].fn(roles, k=100))
    assert "TakeOrderedAndProject" in p and "limit=100" in p


def test_per_group_top_k_is_partial_before_shuffle(roles):
    p = plan(REGISTRY["d23_site_latest_reviews"].fn(roles))
    assert re.search(r"WindowGroupLimit .*Partial", p)


def test_not_in_avoids_null_aware_broadcast(roles):
    p = plan(REGISTRY["c_e13_minus_emulation"].fn(roles))
    assert "isNullAwareAntiJoin" not in p.replace(" ", "") or "BroadcastHashJoin" not in p


def test_pushdown_on_stored_roles(spark, roles, scratch):
    for name, df in roles.as_dict().items():
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
    stored = read_roles(spark, scratch)
    p = plan(REGISTRY["c_p04_monthly_revenue"].fn(stored))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,successful)]" in p
    assert re.search(r"ReadSchema: struct<amount:decimal\(10,2\),status:string,paid_at:timestamp_ntz>", p)


def test_bucketed_roles_join_without_exchange(spark, roles):
    from sitelens.sources.roles import save_roles, table_roles
    save_roles(roles, "sitelens_test", buckets=4)
    tr = table_roles(spark, "sitelens_test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = tr.payments.join(tr.bookings, "booking_id")
        p = plan(j)
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert REGISTRY["c_x11_site_revenue"].fn(tr).count() == REGISTRY["c_x11_site_revenue"].fn(roles).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_salted_lookup_partitions_on_key_and_salt(spark, roles):
    from sitelens.operators.joins import lookup
    _no_broadcast(spark)
    try:
        p = plan(lookup(roles.bookings, roles.sites, "site_id", "site_id", {"name": "s"}, salt_by="booking_id"))
        assert re.search(r"hashpartitioning\(site_id#\d+L, __salt#\d+", p)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_semi_join_probe_side_is_aggregated_before_shuffle(spark, roles):
    from sitelens.operators.joins import semi
    _no_broadcast(spark)
    try:
        p = plan(semi(roles.sites, roles.bookings, "site_id", right_key="site_id"))
        # partial HashAggregate (distinct keys) sits below the probe side's exchange
        assert re.search(r"Exchange hashpartitioning\(__k#\d+L.*\n.*HashAggregate\(keys=\[__k", p)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_left_expand_has_no_outer_join(spark, roles):
    p = plan(REGISTRY["c_g15_guides_without_events"].fn(roles))
    assert "LeftOuter" not in p and "FullOuter" not in p
    assert "FullOuter" not in plan(REGISTRY["b08d_full_join_sites_events"].fn(roles))


def test_status_filter_reaches_the_lineitem_scan(roles):
    p = plan(REGISTRY["c_p04_monthly_revenue"].fn(roles))
    assert "PushedFilters: [EqualNullSafe(l_returnflag,A)]" in p


@pytest.mark.parametrize("name, fact", [
    ("c_p03_payments_last_10", "bookings"), ("c_v07_recent_reviews", "reviews"), ("c_a14_inner_join_assignments", "assignments"),
    ("l5_assignment_list", "assignments"), ("l6_payment_list_page", "bookings"), ("l8_visitor_bookings", "bookings"),
    ("d27_booking_detail_latest_payment", "bookings"), ("d29a_visitor_bookings", "bookings")])
@pytest.mark.parametrize("broadcast", [True, False])
def test_polymorphic_target_reads_the_fact_table_once(spark, roles, scratch, name, fact, broadcast):
    once = 2 if name.startswith("c_p03") else 1      # C-P03 also asks which payments have a booking at all
    for role, df in roles.as_dict().items():
        df.write.mode("overwrite").parquet(f"{scratch}/{role}")
    names = [n for n in REGISTRY if n == name or n.startswith(name)]
    assert names
    if not broadcast:
        _no_broadcast(spark)
    try:
        p = plan(REGISTRY[names[0]].fn(read_roles(spark, scratch)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(rf"Location: InMemoryFileIndex\([^)]*\)\[[^]]*/{fact}\]", p)) == once
