
from __future__ import annotations

import os

import pytest

from sitelens.plans import REGISTRY
from sitelens.sources.roles import load_roles

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="sf0.01 data not present")


@pytest.fixture(scope="module")
def r01(spark):
    return load_roles(spark, SF)


@pytest.mark.parametrize("name,params,rows", [
    ("c_s16_except_emulation", {"k": 10 ** 6}, 1228),            # any booking unpaid
    ("d09_top_site_names_by_bookings", {"k": 10 ** 6}, 64),      # sites grouped by name
    ("u2_intersect_booked_reviewed_sites", {}, 1044),
    ("b13f_except_reviewed_not_booked_sites", {}, 354),
    ("c_e13_minus_emulation", {}, 0),                             # NOT IN with a NULL
    ("d03_overall_avg_rating", {}, 1),
    ("d13_bookings_by_month", {}, 7),                             # 6 months before 2001-08-01
    ("c_x16_rank_sites_by_price", {}, 2000),
    ("d29a_visitor_bookings", {}, 15000),                         # bookings with target names
    ("l7_visitor_list", {"min_bookings": None, "min_rating": None}, 1500),
])
def test_survey_row_counts(r01, name, params, rows):
    assert REGISTRY[name].fn(r01, **params).count() == rows


def test_role_sizes(r01):
    want = {"sites": 2000, "evts": 10000, "visitors": 1500, "bookings": 15000, "payments": 60000, "guides": 100,
            "assignments": 2000, "reviews": 3988}
    assert {n: df.count() for n, df in r01.as_dict().items()} == want


def test_payments_have_a_key(roles):
    n = roles.payments.count()
    assert roles.payments.select("payment_id").distinct().count() == n
    assert roles.payments.where("payment_id IS NULL").count() == 0
