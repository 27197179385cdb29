"""Guides catalogue C-G01..C-G17 and assignments catalogue C-A01..C-A19."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from sitelens.functions import avg_exact, contains_like, ravg
from sitelens.operators.aggs import group_count, per_key
from sitelens.operators.checks import profile_table
from sitelens.operators.aggs import capped
from sitelens.operators.joins import (bounded_product, left_expand, lookup, not_in, pair_counts, resolve_target,
                                      semi)
from sitelens.operators.sets import union_distinct
from sitelens.plans.registry import query
from sitelens.plans.sqlfrag import profile_sql, s_avg, s_ravg
from sitelens.sources.roles import ROLE_SCHEMAS, Roles



@query("C-G01", "guides_basic_info", """
SELECT guide_id, full_name, language, specialization, salary FROM guides ORDER BY full_name, guide_id""")
def guides_basic_info(r: Roles, k: int | None = None):
    """Guides by name (first k)."""
    return r.guides.orderBy("full_name", "guide_id").transform(capped, k)


@query("C-G02", "guides_salary_raise_preview", """
SELECT guide_id, full_name, salary AS current_salary, CAST(salary * 1.10 AS DECIMAL(14,4)) AS increased_salary
FROM guides ORDER BY salary DESC, guide_id""")
def guides_salary_raise_preview(r: Roles, factor: str = "1.10", k: int | None = None):
    """Salary × factor preview (exact decimal arithmetic)."""
    return (r.guides.select("guide_id", "full_name", F.col("salary").alias("current_salary"),
                            (F.col("salary") * F.lit(Decimal(factor))).cast("decimal(14,4)").alias("increased_salary"))
            .orderBy(F.desc("current_salary"), "guide_id").transform(capped, k))


@query("C-G03", "guides_table_structure", profile_sql("guides"))
def guides_table_structure(r: Roles, exact: bool = False):
    """Column profile of the guides table (re-aim of INFORMATION_SCHEMA.COLUMNS)."""
    return profile_table(r.guides, "guides", exact=exact, schema=ROLE_SCHEMAS["guides"])


@query("C-G04", "guides_salary_range", """
SELECT guide_id, full_name, salary FROM guides WHERE salary BETWEEN 20000 AND 60000 ORDER BY salary DESC""")
def guides_salary_range(r: Roles, lo: float = 20000, hi: float = 60000):
    """Guides with salary in [lo, hi]."""
    return (r.guides.where(F.col("salary").between(lo, hi)).select("guide_id", "full_name", "salary")
            .orderBy(F.desc("salary"), "guide_id"))


@query("C-G05", "guides_language_in_set", """
SELECT full_name, language FROM guides WHERE language IN ('English', 'French', 'Spanish') ORDER BY language""")
def guides_language_in_set(r: Roles, languages=("English", "French", "Spanish")):
    """Guides whose language string is one of a set (exact match)."""
    return r.guides.where(F.col("language").isin(*languages)).select("full_name", "language", "guide_id")\
        .orderBy("language", "guide_id").drop("guide_id")


@query("C-G06", "guides_constraints_check", """
SELECT guide_id, full_name, salary FROM guides WHERE salary >= 0 ORDER BY salary DESC""")
def guides_constraints_check(r: Roles):
    """Guides with a valid (non-negative) salary."""
    return (r.guides.where(F.col("salary") >= 0).select("guide_id", "full_name", "salary")
            .orderBy(F.desc("salary"), "guide_id"))


@query("C-G07", "salary_aggregates", f"""
SELECT COUNT(*) AS total_guides, {s_ravg('salary')} AS avg_salary, MAX(salary) AS max_salary,
       MIN(salary) AS min_salary FROM guides""")
def salary_aggregates(r: Roles):
    """COUNT, ROUND(AVG), MAX, MIN of salary."""
    return r.guides.agg(F.count(F.lit(1)).alias("total_guides"), ravg("salary").alias("avg_salary"),
                        F.max("salary").alias("max_salary"), F.min("salary").alias("min_salary"))


@query("C-G08", "guides_per_language", """
SELECT language, COUNT(*) AS total_guides FROM guides GROUP BY language HAVING COUNT(*) > 1
ORDER BY total_guides DESC""")
def guides_per_language(r: Roles, min_guides: int = 1):
    """Guides per language, more than n."""
    return (group_count(r.guides, "language", "total_guides").where(F.col("total_guides") > min_guides)
            .orderBy(F.desc("total_guides"), "language"))


def _above_average(r: Roles):
    return r.guides.where(F.col("salary") > r.guides.select(avg_exact("salary")).scalar())


@query("C-G09", "above_average_guides", f"""
SELECT guide_id, full_name, salary FROM guides WHERE salary > (SELECT {s_avg('salary')} FROM guides)
ORDER BY salary DESC""")
def above_average_guides(r: Roles):
    """Guides above the average salary (uncorrelated scalar subquery)."""
    return _above_average(r).select("guide_id", "full_name", "salary").orderBy(F.desc("salary"), "guide_id")


@query("C-G10", "guides_event_or_site", """
SELECT g.full_name AS guide_name, s.name AS assigned_to, 'Site' AS type
FROM guides g JOIN assignments a ON g.guide_id = a.guide_id JOIN sites s ON a.site_id = s.site_id
UNION
SELECT g.full_name, e.name, 'Event' FROM guides g JOIN assignments a ON g.guide_id = a.guide_id
JOIN evts e ON a.event_id = e.event_id
ORDER BY guide_name""")
def guides_event_or_site(r: Roles):
    """Guide/target names for site and event assignments (UNION, distinct)."""
    g = r.guides.select("guide_id", F.col("full_name").alias("guide_name"))
    a = r.assignments.select("guide_id", "site_id", "event_id")
    to_site = (a.join(r.sites.select("site_id", F.col("name").alias("assigned_to")), "site_id").join(g, "guide_id")
               .select("guide_name", "assigned_to", F.lit("Site").alias("type")))
    to_evt = (a.join(r.evts.select("event_id", F.col("name").alias("assigned_to")), "event_id").join(g, "guide_id")
              .select("guide_name", "assigned_to", F.lit("Event").alias("type")))
    return union_distinct(to_site, to_evt).orderBy("guide_name", "assigned_to", "type")


@query("C-G11", "guides_with_no_assignment", """
SELECT g.full_name FROM guides g WHERE g.guide_id NOT IN (SELECT guide_id FROM assignments)""")
def guides_with_no_assignment(r: Roles):
    """Guides not assigned anywhere (NOT IN with SQL NULL rules)."""
    return not_in(r.guides, "guide_id", r.assignments, "guide_id").select("full_name")


@query("C-G12", "guides_view_example", f"""
SELECT * FROM (SELECT full_name, language, salary FROM guides
               WHERE salary > (SELECT {s_avg('salary')} FROM guides)) AS guides_high_salary
ORDER BY salary DESC""")
def guides_view_example(r: Roles):
    """Derived table 'guides_high_salary'."""
    return _above_average(r).select("full_name", "language", "salary").orderBy(F.desc("salary"))


@query("C-G13", "guides_with_sites", """
SELECT g.full_name, g.language, s.name AS site_name FROM guides g
JOIN assignments a ON g.guide_id = a.guide_id JOIN sites s ON a.site_id = s.site_id ORDER BY g.full_name""")
def guides_with_sites(r: Roles):
    """Guides with their assigned sites (3-way inner join)."""
    a = r.assignments.where(F.col("site_id").isNotNull()).select("guide_id", "site_id")
    return (a.join(r.sites.select("site_id", F.col("name").alias("site_name")), "site_id")
            .join(r.guides.select("guide_id", "full_name", "language"), "guide_id")
            .select("full_name", "language", "site_name").orderBy("full_name", "site_name"))


@query("C-G14", "guides_with_events", """
SELECT g.full_name, e.name AS event_name, e.event_date FROM guides g
LEFT JOIN assignments a ON g.guide_id = a.guide_id LEFT JOIN evts e ON a.event_id = e.event_id
WHERE e.event_id IS NOT NULL ORDER BY e.event_date DESC""")
def guides_with_events(r: Roles):
    """Guides with event assignments (LEFT JOIN + IS NOT NULL = inner join)."""
    a = r.assignments.where(F.col("event_id").isNotNull()).select("guide_id", "event_id")
    return (a.join(r.evts.select("event_id", F.col("name").alias("event_name"), "event_date"), "event_id")
            .join(r.guides.select("guide_id", "full_name"), "guide_id")
            .select("full_name", "event_name", "event_date")
            .orderBy(F.desc("event_date"), "full_name", "event_name"))


@query("C-G15", "guides_without_events", """
SELECT g.full_name, g.language FROM guides g LEFT JOIN assignments a ON g.guide_id = a.guide_id
WHERE a.event_id IS NULL ORDER BY g.full_name""")
def guides_without_events(r: Roles):
    """One row per non-event assignment plus one per unassigned guide (duplicates kept)."""
    a = r.assignments.select(F.col("guide_id").alias("__gid"), "event_id")
    j = left_expand(r.guides.select("guide_id", "full_name", "language"), a, "guide_id", "__gid")
    return j.where(F.col("event_id").isNull()).orderBy("full_name", "guide_id").select("full_name", "language")


@query("C-G16", "guides_cross_join_demo", """
SELECT full_name, potential_language FROM (
  SELECT g.guide_id, g.full_name, l.language AS potential_language FROM guides g
  CROSS JOIN (SELECT DISTINCT language FROM guides WHERE language IS NOT NULL) AS l) t
ORDER BY guide_id, potential_language LIMIT 200""")
def guides_cross_join_demo(r: Roles, k: int = 200):
    """Guide × distinct language, first k pairs: only k guides and k languages can take part."""
    langs = r.guides.where(F.col("language").isNotNull()).select(F.col("language").alias("potential_language")) \
        .distinct()
    p = bounded_product(r.guides.select("guide_id", "full_name"), langs, k, k,
                        [F.col("guide_id")], [F.col("potential_language")])
    return p.orderBy("guide_id", "potential_language").limit(k).select("full_name", "potential_language")


@query("C-G17", "guides_self_join_demo", """
SELECT specialization, COUNT(*) AS n_guides, SUM(others) AS n_pairs FROM (
  SELECT specialization, COUNT(*) OVER (PARTITION BY specialization) - 1 AS others FROM guides) t
WHERE others > 0 AND specialization IS NOT NULL GROUP BY specialization""")
def guides_self_join_demo(r: Roles):
    """Guides sharing a specialization: guides and ordered pairs per specialization (C-S23 lists pairs)."""
    return pair_counts(r.guides, "specialization", "<>", n_out="n_guides")


# ---------------------------------------------------------------- assignments page

_GUIDE_COLS = [("guide_id", "bigint"), ("full_name", "string"), ("language", "string"),
               ("specialization", "string"), ("salary", "decimal(10,2)")]
_GUIDES_STRUCTURE_SQL = " UNION ALL ".join(
    f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, TRUE AS is_nullable, "
    f"COUNT(*) - COUNT({c}) AS nulls, CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value "
    f"FROM guides" for i, (c, t) in enumerate(_GUIDE_COLS))


@query("C-A01", "guides_structure", _GUIDES_STRUCTURE_SQL)
def guides_structure(r: Roles):
    """SHOW COLUMNS re-aimed: type, nullability and observed profile of each guides column."""
    return profile_table(r.guides, "guides").select("ordinal", "column_name", "data_type", "is_nullable",
                                                    "nulls", "min_value", "max_value")


@query("C-A02", "guides_sample_data", """
SELECT guide_id, full_name, language, specialization, salary FROM guides ORDER BY guide_id LIMIT 100""")
def guides_sample_data(r: Roles, k: int = 100):
    """First k guides by id."""
    return r.guides.orderBy("guide_id").limit(k)


@query("C-A03", "guides_salary_range", """
SELECT full_name, language, salary FROM guides WHERE salary BETWEEN 30000 AND 60000 ORDER BY salary DESC""")
def assignments_guides_salary_range(r: Roles, lo: float = 30000, hi: float = 60000):
    """Guides with salary in [lo, hi]."""
    return (r.guides.where(F.col("salary").between(lo, hi)).select("full_name", "language", "salary")
            .orderBy(F.desc("salary")))


@query("C-A04", "guides_language_in", """
SELECT guide_id, full_name, language FROM guides WHERE language IN ('English', 'Bangla', 'French')
ORDER BY language, full_name""")
def guides_language_in(r: Roles, languages=("English", "Bangla", "French")):
    """Guides speaking one of a set of languages."""
    return (r.guides.where(F.col("language").isin(*languages)).select("guide_id", "full_name", "language")
            .orderBy("language", "full_name"))


@query("C-A05", "high_salary_or_special", """
SELECT guide_id, full_name, salary, specialization FROM guides
WHERE salary > 50000 OR specialization LIKE '%Cultural%'""")
def high_salary_or_special(r: Roles, min_salary: float = 50000, word: str = "Cultural"):
    """OR of a range predicate and a LIKE."""
    return (r.guides.where((F.col("salary") > min_salary) | contains_like("specialization", word))
            .select("guide_id", "full_name", "salary", "specialization"))


@query("C-A06", "avg_salary_by_lang", f"""
SELECT language, COUNT(*) AS guide_count, {s_avg('salary')} AS avg_salary FROM guides GROUP BY language
HAVING COUNT(*) > 1 ORDER BY avg_salary DESC""")
def avg_salary_by_lang(r: Roles, min_guides: int = 1):
    """Guide count and unrounded average salary per language."""
    return (r.guides.groupBy("language").agg(F.count(F.lit(1)).alias("guide_count"),
                                             avg_exact("salary").alias("avg_salary"))
            .where(F.col("guide_count") > min_guides).orderBy(F.desc("avg_salary")))


@query("C-A07", "max_min_salary", """SELECT MAX(salary) AS max_salary, MIN(salary) AS min_salary FROM guides""")
def max_min_salary(r: Roles):
    """Highest and lowest salary."""
    return r.guides.agg(F.max("salary").alias("max_salary"), F.min("salary").alias("min_salary"))


@query("C-A08", "guides_above_avg", f"""
SELECT guide_id, full_name, salary FROM guides WHERE salary > (SELECT {s_avg('salary')} FROM guides)
ORDER BY salary DESC""")
def guides_above_avg(r: Roles):
    """Guides above the average salary."""
    return _above_average(r).select("guide_id", "full_name", "salary").orderBy(F.desc("salary"))


@query("C-A09", "guides_with_assignments", """
SELECT full_name FROM guides g WHERE EXISTS (SELECT 1 FROM assignments a WHERE a.guide_id = g.guide_id)""")
def guides_with_assignments(r: Roles):
    """Guides with at least one assignment (EXISTS)."""
    return semi(r.guides, r.assignments, "guide_id", right_key="guide_id").select("full_name")


@query("C-A10", "union_language_groups", """
SELECT guide_id, full_name, language FROM guides WHERE language = 'Bangla'
UNION SELECT guide_id, full_name, language FROM guides WHERE language = 'French' ORDER BY full_name""")
def union_language_groups(r: Roles, first: str = "Bangla", second: str = "French"):
    """UNION of two language groups, ordered over the whole union."""
    g = r.guides.select("guide_id", "full_name", "language")
    return union_distinct(g.where(F.col("language") == first), g.where(F.col("language") == second)) \
        .orderBy("full_name", "guide_id")


@query("C-A11", "intersect_specialization", """
SELECT guide_id, full_name FROM guides WHERE specialization LIKE '%Cultural%'
AND guide_id IN (SELECT guide_id FROM guides WHERE specialization LIKE '%History%')""")
def intersect_specialization(r: Roles, a: str = "Cultural", b: str = "History"):
    """Guides matching two specialization words (self semi join)."""
    other = r.guides.where(contains_like("specialization", b))
    return semi(r.guides.where(contains_like("specialization", a)), other, "guide_id", right_key="guide_id") \
        .select("guide_id", "full_name")


@query("C-A12", "minus_demo", """
SELECT g.guide_id, g.full_name FROM guides g WHERE g.guide_id NOT IN (SELECT guide_id FROM assignments)""")
def minus_demo(r: Roles):
    """Guides not assigned anywhere (NOT IN)."""
    return not_in(r.guides, "guide_id", r.assignments, "guide_id").select("guide_id", "full_name")


@query("C-A13", "view_assignments_summary", """
SELECT g.guide_id, g.full_name, COUNT(a.assign_id) AS total_assignments FROM guides g
LEFT JOIN assignments a ON g.guide_id = a.guide_id GROUP BY g.guide_id, g.full_name
ORDER BY total_assignments DESC""")
def view_assignments_summary(r: Roles):
    """Assignments per guide (zero kept)."""
    per = per_key(r.assignments, "guide_id", [F.count("assign_id").alias("total_assignments")])
    return (r.guides.select("guide_id", "full_name").join(per, "guide_id", "left")
            .fillna({"total_assignments": 0}).orderBy(F.desc("total_assignments"), "guide_id"))


@query("C-A14", "inner_join_assignments", """
SELECT g.full_name, COALESCE(s.name, e.name) AS target_name, a.shift_time FROM assignments a
JOIN guides g ON a.guide_id = g.guide_id LEFT JOIN sites s ON a.site_id = s.site_id
LEFT JOIN evts e ON a.event_id = e.event_id ORDER BY g.full_name""")
def inner_join_assignments(r: Roles):
    """Assignments with guide name and polymorphic target name."""
    a = r.assignments.join(r.guides.select("guide_id", "full_name"), "guide_id")
    return (resolve_target(a, r.sites, r.evts, kind=None, salt_by="assign_id")
            .orderBy("full_name", "assign_id").select("full_name", "target_name", "shift_time"))


@query("C-A15", "left_join_sites", """
SELECT s.name AS site_name, g.full_name AS guide_name FROM sites s
LEFT JOIN assignments a ON s.site_id = a.site_id LEFT JOIN guides g ON a.guide_id = g.guide_id ORDER BY s.name""")
def left_join_sites(r: Roles):
    """All sites with their assigned guides (if any)."""
    a = (r.assignments.where(F.col("site_id").isNotNull()).select(F.col("site_id").alias("__sid"), "guide_id", "assign_id")
         .transform(lambda d: lookup(d, r.guides, "guide_id", "guide_id", {"full_name": "guide_name"})))
    j = left_expand(r.sites.select("site_id", F.col("name").alias("site_name")), a, "site_id", "__sid")
    return j.orderBy("site_name", "site_id", "assign_id").select("site_name", "guide_name")


@query("C-A16", "right_join_demo", """
SELECT g.full_name, s.name AS site_name FROM sites s RIGHT JOIN assignments a ON s.site_id = a.site_id
RIGHT JOIN guides g ON g.guide_id = a.guide_id ORDER BY g.full_name""")
def right_join_demo(r: Roles):
    """All guides, each with its assignments' site names (chained RIGHT JOINs)."""
    a = (r.assignments.select(F.col("guide_id").alias("__gid"), "site_id", "assign_id")
         .transform(lambda d: lookup(d, r.sites, "site_id", "site_id", {"name": "site_name"}, salt_by="assign_id")))
    j = left_expand(r.guides.select("guide_id", "full_name"), a, "guide_id", "__gid")
    return j.orderBy("full_name", "guide_id", "assign_id").select("full_name", "site_name")


@query("C-A17", "cross_join_lang_site", """
SELECT full_name, site_name FROM (SELECT g.guide_id, g.full_name, s.site_id, s.name AS site_name
FROM guides g CROSS JOIN sites s) t ORDER BY guide_id, site_id LIMIT 200""")
def cross_join_lang_site(r: Roles, k: int = 200):
    """Guides × sites, first k combinations (only k guides and k sites can take part)."""
    p = bounded_product(r.guides.select("guide_id", "full_name"), r.sites.select("site_id", F.col("name")
                                                                                   .alias("site_name")),
                        k, k, [F.col("guide_id")], [F.col("site_id")])
    return p.orderBy("guide_id", "site_id").limit(k).select("full_name", "site_name")


@query("C-A18", "self_join_guides", """
SELECT language, COUNT(*) AS n_guides, SUM(before) AS n_pairs FROM (
  SELECT language, ROW_NUMBER() OVER (PARTITION BY language ORDER BY guide_id) - 1 AS before FROM guides) t
WHERE language IS NOT NULL GROUP BY language HAVING COUNT(*) > 1""")
def assignments_self_join_guides(r: Roles):
    """Guides with the same language: guides and unordered pairs per language."""
    return pair_counts(r.guides, "language", "<", n_out="n_guides")


@query("C-A19", "non_equi_join_salary_band", """
SELECT g.full_name, g.salary,
  CASE WHEN g.salary < 30000 THEN 'Low' WHEN g.salary BETWEEN 30000 AND 60000 THEN 'Medium' ELSE 'High' END
  AS salary_band
FROM guides g ORDER BY salary_band, g.salary DESC""")
def non_equi_join_salary_band(r: Roles, low: float = 30000, high: float = 60000):
    """CASE banding of salaries."""
    s = F.col("salary")
    band = F.when(s < low, "Low").when(s.between(low, high), "Medium").otherwise("High")
    return r.guides.select("full_name", "salary", band.alias("salary_band")).orderBy("salary_band", F.desc("salary"))
