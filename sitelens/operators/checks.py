"""Data-quality operators X1 (column profile), X2 (constraint rules), X3 (domain report)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exact_column(df: DataFrame, table: str, ordinal: int, f: T.StructField) -> DataFrame:
    """The profile of one column from the counts of its values."""
    v = F.col("__v")
    values = df.groupBy(F.col(f"`{f.name}`").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))

    def rows(n: Column) -> Column:
        return F.coalesce(F.sum(n), F.lit(0).cast("bigint"))
    one = values.agg(rows(F.col("__n")).alias("row_count"), rows(F.when(v.isNull(), F.col("__n"))).alias("nulls"),
                     F.count(v).alias("distinct_values"), F.min(v).cast("string").alias("min_value"),
                     F.max(v).cast("string").alias("max_value"))
    return one.select(F.lit(table).alias("table_name"), F.lit(ordinal).alias("ordinal"), F.lit(f.name).alias("column_name"),
                      F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("is_nullable"),
                      "row_count", "nulls", "distinct_values", "min_value", "max_value")


def profile_table(df: DataFrame, table: str, exact: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """One row per column: type, nullable, rows, nulls, distinct, min, max.

    One aggregate pass over the table (partial aggregates; distinct counts are
    HyperLogLog++ sketches), then unpivoted by exploding one struct per column —
    as many rows as the table has columns.  ``exact`` counts each column's values
    instead: one narrow grouping per column, so no row is copied once per column.
    ``schema``: the declared columns, to which the table's are cast first.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    fields = (schema or df.schema).fields
    if schema is not None:
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
    if exact:
        return reduce(DataFrame.unionByName, [_exact_column(df, table, i, f) for i, f in enumerate(fields, 1)])
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}"),
                 F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    one = df.agg(*aggs)
    parts = []
    for i, f in enumerate(fields):
        parts.append(F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("is_nullable"),
            (F.col("__rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_values"),
            F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")))
    return (one.select(F.col("__rows").alias("row_count"), F.explode(F.array(*parts)).alias("p"))
            .select(F.lit(table).alias("table_name"), "p.ordinal", "p.column_name", "p.data_type",
                    "p.is_nullable", "row_count", "p.nulls", "p.distinct_values", "p.min_value", "p.max_value"))


def table_list(tables: dict[str, DataFrame]) -> DataFrame:
    """X1 table level: name, number of columns, rows (one count per table)."""
    parts = [df.agg(F.count(F.lit(1)).alias("table_rows"))
             .select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), "table_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Column      # TRUE for a violating row


def violations(df: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame:
    """(rule, key…) for every row that breaks a row-level rule.

    All rules are evaluated in one scan: each row yields the array of rule
    names it violates, exploded afterwards.
    """
    tags = F.filter(F.array(*[F.when(r.predicate, F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return (df.select(*key, tags.alias("__v")).where(F.size("__v") > 0)
            .select(F.explode("__v").alias("rule"), *key))


def xor_target_rule(site: str = "site_id", event: str = "event_id") -> list[Rule]:
    return [Rule("both_targets", F.col(site).isNotNull() & F.col(event).isNotNull()),
            Rule("no_target", F.col(site).isNull() & F.col(event).isNull())]


def duplicate_keys(df: DataFrame, key: Sequence[str], rule: str = "duplicate_key") -> DataFrame:
    """X2 uniqueness: keys that occur more than once, with their count."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"))
            .where(F.col("occurrences") > 1).withColumn("rule", F.lit(rule)))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """X2 foreign keys: child rows whose non-NULL ``fk`` has no parent."""
    p = parent.select(F.col(pk).alias("__pk"))
    return child.where(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("__pk"), "left_anti")


def domain_report(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """Observed values of ``col`` with counts against the declared domain.

    Output: value, rows, declared (bool), declared_position (1-based, NULL if
    outside).  Declared values that never occur appear with rows = 0.
    """
    # The declared values join in as rows that count nothing: one aggregate, no join.
    domain = df.sparkSession.createDataFrame([(v, 0, i + 1) for i, v in enumerate(allowed)],
                                             "value string, n bigint, declared_position int")
    observed = df.select(F.col(col).alias("value"), F.lit(1).cast("bigint").alias("n"),
                         F.lit(None).cast("int").alias("declared_position"))
    out = observed.unionByName(domain).groupBy("value").agg(
        F.sum("n").alias("rows"), F.max("declared_position").alias("declared_position"))
    return out.select("value", "rows", F.col("declared_position").isNotNull().alias("declared"), "declared_position")

