"""Pages from the page directory equal OFFSET and LIMIT, and open their own files only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitelens.plans.listings import Page
from sitelens.sources.pages import PagedTable

SORT = [("amount", False), ("paid_at", True), ("payment_id", True)]


@pytest.fixture(scope="module")
def paged(spark, roles, tmp_path_factory):
    t = PagedTable(spark, str(tmp_path_factory.mktemp("paged") / "t"), SORT)
    t.write(roles.payments, rows_per_file=500)
    return t


@pytest.mark.parametrize("number, size", [(1, 10), (2, 700), (57, 100), (60_000, 1), (3, 499), (10 ** 6, 10)])
def test_pages_equal_offset(roles, paged, number, size):
    page = Page(number, size)
    want = roles.payments.orderBy(*paged.order).offset(page.offset).limit(size).collect()
    assert paged.page(page).select(*roles.payments.columns).collect() == want


def test_a_deep_page_opens_few_files(roles, paged):
    assert paged.count() == roles.payments.count()
    assert paged.directory().agg(F.max("n")).first()[0] <= 500
    assert len(paged.page(Page(300, 10)).inputFiles()) <= 2


def test_empty_table(spark, roles, scratch):
    t = PagedTable(spark, f"{scratch}/t", SORT)
    t.write(roles.payments.limit(0))
    assert t.count() == 0 and t.page(Page(1, 10)).collect() == []
