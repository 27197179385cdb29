"""Operator semantics on the seed fixture and against brute force."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.operators.joins import lookup, not_in, resolve_target, top_pairs
from sitelens.operators.windows import latest_per_key, rank_by, top_k_per_group
from sitelens.plans import REGISTRY


def _key(t):
    return tuple((x is None, x if x is not None else 0) for x in t)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)


def test_not_in_sql_null_rules(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    clean = spark.createDataFrame([(2,)], "k long")
    with_null = spark.createDataFrame([(2,), (None,)], "k long")
    empty = spark.createDataFrame([], "k long")
    assert rows(not_in(left, "k", clean, "k"), "k") == [(1,)]
    assert rows(not_in(left, "k", with_null, "k"), "k") == []
    assert len(rows(not_in(left, "k", empty, "k"), "k")) == 3


def test_minus_emulation_null_trap_is_empty(roles):
    assert REGISTRY["c_e13_minus_emulation"].fn(roles).count() == 0
    assert REGISTRY["c_e10_exists_notexists"].fn(roles).count() > 0


def test_except_emulation_is_per_booking(seed):
    # site 1 has a paid booking (1000) and an unpaid one (1001): kept; site 5 paid → dropped.
    got = rows(REGISTRY["c_s16_except_emulation"].fn(seed), "site_id")
    assert got == [(1,), (2,)]


def test_site_revenue_null_vs_zero(seed):
    rev = {r["site_id"]: r["revenue"] for r in REGISTRY["c_x11_site_revenue"].fn(seed).collect()}
    assert rev[6] is None and str(rev[1]) == "100.00" and str(rev[5]) == "70.00"
    rev0 = {r["site_id"]: r["revenue"] for r in REGISTRY["c_s17_views_example"].fn(seed).collect()}
    assert str(rev0[6]) == "0.00"


def test_overall_rating_counts_null_group(seed):
    # per-site averages: site1 4.5, site5 2, NULL (event reviews) 3 → mean 3.17
    v = REGISTRY["d03_overall_avg_rating"].fn(seed).collect()[0][0]
    assert str(v) == "3.17"


def test_rank_matches_window_rank(roles):
    got = rank_by(roles.sites.select("site_id", "ticket_price"), "ticket_price", "r", buckets=7)
    ref = roles.sites.select("site_id", F.rank().over(Window.orderBy(F.desc("ticket_price"))).alias("r"))
    assert rows(got, "site_id", "r") == rows(ref, "site_id", "r")


def test_rank_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 7.0)], "id long, v double")
    assert rows(rank_by(df, "v", "r"), "id", "r") == [(1, 2), (2, 2), (3, 4), (4, 1)]


def test_latest_per_key_equals_row_number(roles):
    cols = ["booking_id", "paid_at", "attempt_no", "acquirer_id", "amount", "method", "status"]
    p = roles.payments.select(*cols)
    got = latest_per_key(p, "booking_id", cols[1:])
    w = Window.partitionBy("booking_id").orderBy(*[F.desc(c) for c in cols[1:]])
    ref = p.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    assert rows(got, *cols) == rows(ref, *cols)


def test_lookup_salting_matches_plain_join(roles):
    plain = lookup(roles.bookings, roles.sites, "site_id", "site_id", {"name": "s"})
    salted = lookup(roles.bookings, roles.sites, "site_id", "site_id", {"name": "s"}, salt_by="booking_id")
    assert rows(plain, "booking_id", "s") == rows(salted, "booking_id", "s")


def test_resolve_target_kind(seed):
    got = {r["booking_id"]: (r["target_name"], r["target_kind"])
           for r in resolve_target(seed.bookings, seed.sites, seed.evts).collect()}
    assert got[1000] == ("Old Fort", "site")
    assert got[1002] == ("Light Festival", "event")
    assert got[1006] == (None, None)


def test_top_pairs_equals_brute_force(roles):
    e = roles.evts.select("event_id", "name", "event_date")
    got = top_pairs(e, "event_date", "event_id", {"event_id": "e1", "event_date": "event_date"},
                    {"event_id": "e2"}, "<>", [F.desc("event_date")], 37)
    a, b = e.alias("a"), e.alias("b")
    brute = (a.join(b, (F.col("a.event_date") == F.col("b.event_date")) & (F.col("a.event_id") != F.col("b.event_id")))
             .select(F.col("a.event_id").alias("e1"), F.col("b.event_id").alias("e2"), F.col("a.event_date"))
             .orderBy(F.desc("event_date"), "e1", "e2").limit(37))
    assert [tuple(r) for r in got.select("e1", "e2").collect()] == [tuple(r) for r in brute.select("e1", "e2").collect()]


def test_top_k_per_group_equals_brute_force(roles):
    got = top_k_per_group(roles.reviews, "site_id", [F.desc("review_date"), F.asc("review_id")], 3)
    pdf = roles.reviews.toPandas().sort_values(["review_date", "review_id"], ascending=[False, True])
    brute = pdf.groupby("site_id", dropna=False).head(3)
    assert sorted(r["review_id"] for r in got.collect()) == sorted(brute["review_id"].tolist())


def test_related_sites_capped_equals_brute(roles):
    got = REGISTRY["d26_related_sites"].fn(roles)
    pdf = roles.sites.select("site_id", "type", "name").toPandas()
    m = pdf.merge(pdf, on="type", suffixes=("", "_o"))
    m = m[m.site_id != m.site_id_o].sort_values(["site_id", "name_o", "site_id_o"])
    brute = m.groupby("site_id").head(6)
    assert sorted(zip(brute.site_id.tolist(), brute.site_id_o.tolist())) == rows(got, "site_id", "related_id")


def test_related_sites_deals_sites_before_sorting(roles):
    plan = REGISTRY["d26_related_sites"].fn(roles)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line:
            assert any("RepartitionByExpression" in below for below in lines[i:])
    assert plan.count("RepartitionByExpression") == 3


def test_exact_profile_copies_no_row_per_column(spark):
    from sitelens.operators.checks import profile_table
    df = spark.createDataFrame([(1, "a"), (1, None), (3, "b"), (None, "b")], "k long, v string")
    got = profile_table(df, "t", exact=True)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[1:] for r in got.orderBy("ordinal").collect()] == [
        (1, "k", "bigint", True, 4, 1, 2, "1", "3"), (2, "v", "string", True, 4, 1, 2, "a", "b")]
    assert [tuple(r)[5:] for r in profile_table(df.limit(0), "t", exact=True).collect()] == [(0, 0, 0, None, None)] * 2


def test_fulltext_tokens_not_substrings(seed):
    # 'Museums nearby' must not match the token 'museum'; short words are ignored.
    got = rows(REGISTRY["c_s28_fulltext_sample"].fn(seed), "site_id")
    assert got == [(1,), (2,), (5,)]
    assert REGISTRY["c_s28_fulltext_sample"].fn(seed, q="+of").count() == 0


def test_field_order_unknown_first(seed):
    got = [r["site_id"] for r in REGISTRY["c_s07_ordering_by_multiple_columns"].fn(seed).collect()]
    assert got == [1, 3, 5, 4, 2, 6]


def test_listing_pages_concatenate_to_full(roles):
    from sitelens.plans.listings import Page, site_search
    lst = site_search(roles, "desc")
    full = [r["site_id"] for r in lst.frame.orderBy(*lst.order).collect()]
    pages = []
    for p in range(1, 6):
        pages += [r["site_id"] for r in lst.page(Page(p, 6)).collect()]
    assert pages == full[:30]


def test_semi_plus_anti_is_whole(roles):
    s = REGISTRY["c_x06_sites_with_bookings_in"].fn(roles).count()
    a = REGISTRY["c_x08_sites_without_bookings"].fn(roles).count()
    assert s + a == roles.sites.count()


def test_index_search_equals_row_predicate(roles):
    from sitelens.operators.text_search import index_search, match_rows, token_index
    docs = roles.extra["documents"]
    idx = token_index(docs, "doc_id", "text")
    for q in ["+with -the", "and with", "+les +des", "-the", "+of", "zzzz"]:
        a = rows(match_rows(docs, "text", q), "doc_id")
        b = rows(index_search(idx, docs, "doc_id", q), "doc_id")
        assert a == b, q


def test_ci_grouping_merges_case_and_accents(spark, seed):
    sites = seed.sites.unionByName(spark.createDataFrame(
        [(7, "x", "RIVERTOWN", "Fort", None, "None", "d", None, None),
         (8, "y", "rivertówn", "Fort", None, "None", "d", None, None)],
        seed.sites.schema))
    r = seed.with_tables(sites=sites)
    plain = {row["location"]: row["cnt"] for row in REGISTRY["c_x02_count_sites_by_location"].fn(r).collect()}
    ci = {row["location"]: row["cnt"] for row in REGISTRY["c_x02_count_sites_by_location"].fn(r, ci=True).collect()}
    assert plain["Rivertown"] == 2 and plain["RIVERTOWN"] == 1
    assert ci["RIVERTOWN"] == 4 and None in ci


def test_normalise_seed_repairs_names_and_types(spark):
    from sitelens.sources.seed import normalise_seed
    raw = spark.createDataFrame([("1", "Ann", "ann@x.org", "oops", "BD")],
                                "visitor_id string, name string, email string, created_at string, extra string")
    out = normalise_seed(raw, "visitors")
    row = out.collect()[0]
    assert out.columns == ["visitor_id", "full_name", "nationality", "email", "created_at", "phone"]
    assert (row["visitor_id"], row["full_name"], row["created_at"]) == (1, "Ann", None)


def test_normalise_seed_keeps_wide_payment_ids(spark):
    from sitelens.sources.seed import normalise_seed
    raw = spark.createDataFrame([("3000000000", "7")], "payment_id string, booking_id string")
    assert normalise_seed(raw, "payments").first()["payment_id"] == 3_000_000_000


def test_constraint_report_on_seed(seed):
    got = {(r["table_name"], r["rule"], r["row_id"]) for r in REGISTRY["x2r_constraint_report"].fn(seed).collect()}
    assert ("bookings", "both_targets", 1005) in got and ("bookings", "no_target", 1006) in got
    assert ("payments", "fk_booking_id", 9999) in got and ("payments", "method_outside_domain", 9999) in got
    assert ("guides", "negative_salary", 4) in got and ("evts", "capacity_not_positive", 11) in got
    assert ("visitors", "duplicate_email", 100) not in got


def test_keyset_pages_equal_offset_pages_with_nulls(roles):
    from sitelens.plans.listings import visitor_list
    lst = visitor_list(roles, sort="avg_rating", order="DESC")   # avg_rating has NULLs (no reviews)
    full = [r["visitor_id"] for r in lst.frame.orderBy(*lst.order).collect()]
    keys = [c for c, _ in lst.sort]
    got, last = [], None
    for _ in range(200):
        page = lst.page_after(last, 17).collect()
        if not page:
            break
        got += [r["visitor_id"] for r in page]
        last = tuple(page[-1][k] for k in keys)
    assert got == full


def test_cli_runs_registered_queries_only(capsys):
    from sitelens.__main__ import main
    assert main(["run", "no_such_query", "--data", "/tmp"]) == 2
    assert main(["list", "c_x11"]) == 0
    assert "c_x11_site_revenue" in capsys.readouterr().out


def test_rank_orders_by_the_value_itself(spark):
    from sitelens.operators.windows import rank_by
    big = [(2 ** 53 + i,) for i in range(6)]
    got = {r["v"]: r["rank"] for r in rank_by(spark.createDataFrame(big, "v long"), "v").collect()}
    assert got == {2 ** 53 + i: 6 - i for i in range(6)}
    names = [("b",), ("abcdefgh",), ("abcdefgi",), (None,), ("é",)]
    up = {r["v"]: r["rank"] for r in rank_by(spark.createDataFrame(names, "v string"), "v", descending=False).collect()}
    assert up == {None: 1, "abcdefgh": 2, "abcdefgi": 3, "b": 4, "é": 5}


def test_full_text_words_with_punctuation(spark):
    from sitelens.functions.text import boolean_match
    df = spark.createDataFrame([("a world-heritage site",), ("worldheritage",)], "t string")
    assert [r["t"] for r in df.where(boolean_match("t", "+world-heritage")).collect()] == ["a world-heritage site"]
