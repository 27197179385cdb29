"""Shared fixtures: one local Spark session, role views, DuckDB oracle, seed fixture."""

from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sitelens.session import checkpoint_dir, get_spark  # noqa: E402
from sitelens.sources.roles import ROLE_SCHEMAS, Roles, load_roles  # noqa: E402

SF_DIR = os.environ.get("SITELENS_TEST_SF", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[4]", shuffle_partitions=4, warehouse=tempfile.mkdtemp(prefix="sitelens-wh-"))
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def roles(spark) -> Roles:
    return load_roles(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    yield con
    con.close()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="sitelens-test-")


D = Decimal
T0 = dt.datetime(2001, 7, 1, 10, 0)


def seed_tables():
    """Hand-made fixture with the edge rows the driver data lacks (FIXTURES.md §1)."""
    sites = [
        (1, "Old Fort", "Rivertown", "Fort", D("50.00"), "World Heritage", "Hill fort and museum", dt.date(2020, 1, 1)),
        (2, "National Museum", "Rivertown", "Museum", D("50.00"), "None", "The national museum", dt.date(2020, 2, 1)),
        (3, "Domed Mosque", "Portville", "Mosque", D("30.00"), "World Heritage", "Museums nearby", dt.date(2020, 3, 1)),
        (4, "Hill Vihara", None, "Monastery", D("0.00"), "Tentative", "old vihara", dt.date(2020, 4, 1)),
        (5, "National Museum", "Seaside", "Museum", D("80.00"), "Tentative", "Second national museum", dt.date(2020, 5, 1)),
        (6, "Quiet Ruin", "Tealands", "Ancient City", D("50.00"), "None", "no visitors yet", dt.date(2020, 6, 1)),
    ]
    evts = [
        (10, 1, "Light Festival", dt.date(2001, 8, 10), D("100.00"), 2, "festival"),
        (11, 1, "Night Walk", dt.date(2001, 6, 10), D("20.00"), 0, "walk"),
        (12, 2, "Museum Talk", dt.date(2001, 8, 20), D("200.00"), 100, "talk"),
        (13, 3, "Lantern Festival", dt.date(2001, 8, 10), D("60.00"), 1, "festival"),
    ]
    visitors = [
        (100, "Alice", "BD", "alice@example.com", dt.date(2000, 1, 1)),
        (101, "Bob", "IN", "bob@example.com", dt.date(2000, 2, 1)),
        (102, "Carol", None, "carol@example.com", dt.date(2000, 3, 1)),
        (103, "alice", "BD", "ALICE2@example.com", dt.date(2000, 4, 1)),
    ]
    bookings = [
        (1000, 100, 1, None, T0, 2, D("100.00"), "paid"),
        (1001, 100, 1, None, T0 + dt.timedelta(days=1), 1, D("50.00"), "pending"),
        (1002, 101, None, 10, T0 + dt.timedelta(days=2), 3, D("300.00"), "paid"),
        (1003, 101, None, 13, T0 + dt.timedelta(days=3), 1, D("60.00"), "paid"),
        (1004, 100, None, 13, T0 + dt.timedelta(days=3), 1, D("60.00"), "pending"),
        (1005, 102, 2, 12, T0 + dt.timedelta(days=4), 1, D("50.00"), "pending"),
        (1006, 102, None, None, T0 + dt.timedelta(days=5), 1, D("10.00"), "failed"),
        (1007, 101, 5, None, T0 + dt.timedelta(days=6), 1, D("80.00"), "paid"),
    ]
    payments = [
        (1, 1000, 1, 7, D("100.00"), "bkash", "successful", T0),
        (2, 1001, 1, 7, D("50.00"), "card", "failed", T0),
        (3, 1002, 1, 8, D("150.00"), "nagad", "successful", T0),
        (4, 1002, 2, 8, D("150.00"), "nagad", "successful", T0 + dt.timedelta(hours=1)),
        (5, 1003, 1, 9, D("60.00"), "card", "initiated", T0),
        (6, 9999, 1, 9, D("5.00"), "cash", "successful", T0),
        (7, 1007, 1, 7, D("70.00"), "rocket", "successful", T0),
    ]
    guides = [
        (1, "Amir", "Bangla", "History", D("40000.00")),
        (2, "Bela", "English", "Cultural History", D("65000.00")),
        (3, "Chen", "Bangla", "History", D("25000.00")),
        (4, "Dara", "Bangla, English", "Art", D("-10.00")),
    ]
    assignments = [
        (1, 1, 1, None, "Morning"),
        (2, 1, None, 10, "Evening"),
        (3, 2, 3, None, "Afternoon"),
        (4, 3, 1, None, "Morning"),
    ]
    reviews = [
        (1, 100, 1, None, 5, "great", dt.date(2001, 7, 2)),
        (2, 101, 1, None, 4, "good", dt.date(2001, 7, 3)),
        (3, 101, None, 10, 3, "ok event", dt.date(2001, 7, 4)),
        (4, 102, 5, None, 2, "meh", dt.date(2001, 7, 5)),
    ]
    return dict(sites=sites, evts=evts, visitors=visitors, bookings=bookings, payments=payments, guides=guides,
                assignments=assignments, reviews=reviews)


@pytest.fixture(scope="session")
def seed(spark) -> Roles:
    data = seed_tables()
    # columns beyond the hand-written ones (opening hours, event time, phone) are NULL
    frames = {n: spark.createDataFrame([(*t, *[None] * (len(ROLE_SCHEMAS[n]) - len(t))) for t in rows], ROLE_SCHEMAS[n])
              for n, rows in data.items()}
    return Roles(**frames, as_of_sales=dt.date(2001, 8, 1), as_of_events=dt.date(2001, 8, 1))
