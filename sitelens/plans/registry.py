"""Registry of named catalogue queries.

Each entry pairs a DataFrame builder ``fn(roles, **params)`` with an optional
DuckDB/ANSI SQL text over the role views, used as the correctness oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from sitelens.sources.roles import Roles


@dataclass(frozen=True)
class QuerySpec:
    qid: str            # survey id, e.g. "C-X11"
    key: str            # reference key, e.g. "site_revenue"
    fn: Callable[..., DataFrame]
    sql: str | None     # oracle SQL body (role views are prepended)
    title: str
    params: dict = field(default_factory=dict)   # the entry's parameters, see ``bind``

    @property
    def name(self) -> str:
        return f"{self.qid.lower().replace('-', '_')}_{self.key}"

    def entry(self, roles: Roles) -> DataFrame:
        """The registered query: the builder with the entry's parameters."""
        return self.fn(roles, **self.params)


REGISTRY: dict[str, QuerySpec] = {}


def query(qid: str, key: str, sql: str | None = None, title: str = ""):
    def deco(fn: Callable[..., DataFrame]):
        spec = QuerySpec(qid, key, fn, sql, title or (fn.__doc__ or "").strip().split("\n")[0])
        if spec.name in REGISTRY:
            raise ValueError(f"duplicate query {spec.name}")
        REGISTRY[spec.name] = spec
        return fn
    return deco


def bind(name: str, params: dict, literals: dict[str, str]) -> None:
    """Run the entry ``name`` with ``params`` and its oracle with the same values as ``literals``.

    The builder's own defaults stay as they are.
    """
    spec = REGISTRY[name]
    sql = spec.sql
    for old, new in literals.items():
        if old not in sql:
            raise ValueError(f"{name}: the oracle has no {old!r}")
        sql = sql.replace(old, new)
    REGISTRY[name] = replace(spec, sql=sql, params=params)


def run(name: str, roles: Roles, **params) -> DataFrame:
    return REGISTRY[name].fn(roles, **params)
