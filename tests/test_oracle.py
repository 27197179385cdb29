"""Every registered query with an oracle: Spark result == DuckDB result (rows, columns, values)."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib

import pytest

from sitelens.plans import REGISTRY
from sitelens.plans.oracle import with_roles

ORACLE = sorted(n for n, s in REGISTRY.items() if s.sql)
ROWS_ONLY = sorted(n for n, s in REGISTRY.items() if not s.sql)


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.mark.parametrize("name", ORACLE)
def test_matches_oracle(name, roles, duck):
    df = REGISTRY[name].entry(roles)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(with_roles(REGISTRY[name].sql))
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs_with_stable_schema(name, roles):
    df = REGISTRY[name].fn(roles)
    first = df.schema
    n = df.count()
    assert n >= 0
    assert REGISTRY[name].fn(roles).schema == first


def test_registry_covers_survey_ids():
    ids = {s.qid for s in REGISTRY.values()}
    explorer = {f"C-X{i:02d}" for i in range(1, 19)}
    sites = {f"C-S{i:02d}" for i in range(1, 31)} - {"C-S03"}
    events = {f"C-E{i:02d}" for i in range(1, 23)}
    guides = {f"C-G{i:02d}" for i in range(1, 18)}
    assigns = {f"C-A{i:02d}" for i in range(1, 20)}
    payments = {f"C-P{i:02d}" for i in range(1, 8)}
    visitors = {f"C-V{i:02d}" for i in range(1, 10)}
    missing = (explorer | sites | events | guides | assigns | payments | visitors) - ids
    assert not missing, sorted(missing)
