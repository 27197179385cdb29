"""Property tests: operators against brute force on random small tables (Hypothesis)."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.operators.joins import lookup, not_in, pair_counts, top_pairs
from sitelens.operators.sets import union_distinct
from sitelens.operators.windows import latest_per_key, rank_by

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
keys = st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=12)


def _k(t):
    return tuple((x is None, x if x is not None else 0) for x in t)


@SETTINGS
@given(left=keys, right=keys)
def test_not_in_matches_sql_semantics(spark, left, right):
    l = spark.createDataFrame([(x,) for x in left], "k long")
    r = spark.createDataFrame([(x,) for x in right], "k long")
    got = sorted((row["k"] for row in not_in(l, "k", r, "k").collect()), key=lambda x: (x is None, x or 0))
    if not right:
        want = left
    elif any(x is None for x in right):
        want = []
    else:
        want = [x for x in left if x is not None and x not in right]
    assert got == sorted(want, key=lambda x: (x is None, x or 0))


@SETTINGS
@given(vals=st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=15), desc=st.booleans())
def test_rank_by_matches_sql_rank(spark, vals, desc):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long")
    got = {r["id"]: r["rk"] for r in rank_by(df, "v", "rk", descending=desc, buckets=3).collect()}
    # SQL RANK: 1 + rows strictly before; NULLs last under DESC, first under ASC.
    def before(a, b):
        if a is None or b is None:
            return (a is not None and b is None) if desc else (a is None and b is not None)
        return a > b if desc else a < b
    want = {i: 1 + sum(before(w, v) for w in vals) for i, v in enumerate(vals)}
    assert got == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=15))
def test_latest_per_key_is_max_tuple(spark, rows):
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = sorted(tuple(r) for r in latest_per_key(df, "k", ["t", "v"]).collect())
    want = sorted({k: max((t, v) for kk, t, v in rows if kk == k) for k, _, _ in rows}.items())
    assert got == [(k, t, v) for k, (t, v) in want]


@SETTINGS
@given(groups=st.lists(st.integers(0, 3), min_size=2, max_size=14), k=st.integers(1, 20),
       op=st.sampled_from(["<>", "<"]))
def test_top_pairs_and_pair_counts_match_brute_force(spark, groups, k, op):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "id long, g long")
    rel = (lambda a, b: a != b) if op == "<>" else (lambda a, b: a < b)
    brute = sorted((g1, a, b) for a, g1 in enumerate(groups) for b, g2 in enumerate(groups)
                   if g1 == g2 and rel(a, b))
    got = top_pairs(df, "g", "id", {"id": "a", "g": "g"}, {"id": "b"}, op, [F.asc("g")], k)
    assert [(r["g"], r["a"], r["b"]) for r in got.collect()] == brute[:k]
    counts = {r["g"]: (r["n"], r["n_pairs"]) for r in pair_counts(df, "g", op).collect()}
    assert counts == {g: (groups.count(g), sum(b[0] == g for b in brute)) for g in {b[0] for b in brute}}


@SETTINGS
@given(a=st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["x", "y", None])), max_size=10))
def test_union_distinct_idempotent(spark, a):
    df = spark.createDataFrame(a, "k long, s string")
    once = union_distinct(df, df)
    twice = union_distinct(once, df)
    assert sorted(map(_k, map(tuple, once.collect()))) == sorted(map(_k, map(tuple, twice.collect())))
    assert once.count() == len(set(a))


@SETTINGS
@given(fks=st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=12))
def test_salted_lookup_equals_left_join(spark, fks):
    f = spark.createDataFrame([(i, k) for i, k in enumerate(fks)], "id long, fk long")
    d = spark.createDataFrame([(k, f"n{k}") for k in range(0, 6, 2)], "pk long, name string")
    got = sorted(tuple(r) for r in lookup(f, d, "fk", "pk", {"name": "nm"}, salt_by="id", null_buckets=3)
                 .select("id", "nm").collect())
    want = sorted((i, f"n{k}" if k is not None and k % 2 == 0 else None) for i, k in enumerate(fks))
    assert got == want


@SETTINGS
@given(lk=st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=8),
       rk=st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=12))
def test_left_expand_equals_left_join(spark, lk, rk):
    from sitelens.operators.joins import left_expand
    left = spark.createDataFrame([(i, k) for i, k in enumerate(lk)], "lid long, k long")
    right = spark.createDataFrame([(j, k) for j, k in enumerate(rk)], "rid long, rk long")
    got = sorted(map(_k, (tuple(r) for r in left_expand(left, right, "k", "rk").select("lid", "rid").collect())))
    ref = left.join(right, left.k == right.rk, "left").select("lid", "rid")
    assert got == sorted(map(_k, (tuple(r) for r in ref.collect())))


@SETTINGS
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 4))),
                     max_size=12), salt=st.booleans())
def test_resolve_target_equals_coalesce_of_two_lookups(spark, rows, salt):
    from sitelens.operators.joins import resolve_target
    facts = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(rows)], "fid long, site_id long, event_id long")
    sites = spark.createDataFrame([(k, f"s{k}") for k in (0, 1, 3)], "site_id long, name string")
    evts = spark.createDataFrame([(k, f"e{k}") for k in (1, 2, 4)], "event_id long, name string")
    sb = "fid" if salt else None
    got = sorted(map(_k, (tuple(r) for r in resolve_target(facts, sites, evts, salt_by=sb)
                          .select("fid", "target_name", "target_kind").collect())))
    def name(s, e):
        if s in (0, 1, 3):
            return f"s{s}", "site"
        return (f"e{e}", "event") if e in (1, 2, 4) else (None, None)
    assert got == sorted(map(_k, ((i, *name(s, e)) for i, (s, e) in enumerate(rows))))


@SETTINGS
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 4))),
                     max_size=12))
def test_target_names_equal_two_lookups(spark, rows):
    from sitelens.operators.joins import target_names
    facts = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(rows)], "fid long, site_id long, event_id long")
    sites = spark.createDataFrame([(k, f"s{k}") for k in (0, 1, 3)], "site_id long, name string")
    evts = spark.createDataFrame([(k, f"e{k}") for k in (1, 2, 4)], "event_id long, name string")
    got = sorted(map(_k, (tuple(r) for r in target_names(facts, sites, evts, salt_by="fid")
                          .select("fid", "site_name", "event_name").collect())))
    ref = (facts.join(sites.withColumnRenamed("name", "site_name"), "site_id", "left")
           .join(evts.withColumnRenamed("name", "event_name"), "event_id", "left"))
    assert got == sorted(map(_k, (tuple(r) for r in ref.select("fid", "site_name", "event_name").collect())))
