"""Catalogue of named queries; importing this package registers all of them."""

from sitelens.plans import (dashboard, events, explorer, exports, guides, jobs_catalog, labs,  # noqa: F401
                            listings, people, quality, sites)
from sitelens.plans import bindings, collated  # noqa: F401  (after the catalogue)
from sitelens.plans.registry import REGISTRY, QuerySpec, query, run

__all__ = ["REGISTRY", "QuerySpec", "query", "run"]
