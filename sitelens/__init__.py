"""sitelens: ticketed-venue analytics on Spark.

Role tables (sites, evts, visitors, bookings, payments, guides, assignments,
reviews) are DataFrames; every operator and catalogue query takes them and
returns a lazy DataFrame, so Catalyst sees one plan per query.
"""

from sitelens.session import get_spark, checkpoint_dir
from sitelens.sources.roles import Roles, load_roles

__all__ = ["get_spark", "checkpoint_dir", "Roles", "load_roles"]
