"""M4: referential actions after deletes (CASCADE, SET NULL, RESTRICT), XOR conflicts reported.

The model's foreign keys are declared once (``FOREIGN_KEYS``); everything follows from
that graph.  What a call deletes in a table is what it asks for, less what RESTRICT
refuses, plus what CASCADE brings along, worked out table by table in the order that
the graph gives.  The deleted keys of all tables together form one set of (table, key).

A child table meets that set once: every row gives one narrow candidate per foreign key
that can be hit, (parent, value, row key), the candidates are semi-joined, and the hits -
few, when few rows are deleted - are gathered per row key and joined to the child.  Foreign
keys whose parent loses nothing take no part, and a table without any stays as it is.

SET NULL on the only target of an XOR row would break the one-target rule, so those
rows are reported (``conflicts``) instead of silently kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.sources.roles import ROLE_NAMES, Roles

KEYS = {"sites": "site_id", "evts": "event_id", "visitors": "visitor_id", "bookings": "booking_id",
        "guides": "guide_id", "payments": "payment_id", "assignments": "assign_id", "reviews": "review_id"}

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str


FOREIGN_KEYS = (
    ForeignKey("evts", "site_id", "sites", CASCADE),
    ForeignKey("bookings", "visitor_id", "visitors", RESTRICT),
    ForeignKey("bookings", "site_id", "sites", SET_NULL),
    ForeignKey("bookings", "event_id", "evts", SET_NULL),
    ForeignKey("payments", "booking_id", "bookings", CASCADE),
    ForeignKey("assignments", "guide_id", "guides", CASCADE),
    ForeignKey("assignments", "site_id", "sites", SET_NULL),
    ForeignKey("assignments", "event_id", "evts", SET_NULL),
    ForeignKey("reviews", "visitor_id", "visitors", CASCADE),
    ForeignKey("reviews", "site_id", "sites", SET_NULL),
    ForeignKey("reviews", "event_id", "evts", SET_NULL),
)
#: Tables whose rows name exactly one of two targets.
ONE_TARGET = ("bookings", "assignments", "reviews")


@dataclass
class DeleteResult:
    roles: Roles
    conflicts: DataFrame     # table_name, row_id, nulled_column
    refused: DataFrame       # table_name, key  (RESTRICT violations: parent kept)


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for f in frames:
        out = out.unionByName(f)
    return out


class _Deletes:
    """The deleted keys of every table, each worked out once (None: the table loses no row)."""

    def __init__(self, r: Roles, requested: dict[str, DataFrame | None], graph: tuple[ForeignKey, ...]):
        self.tables, self.requested, self.graph = r.as_dict(), requested, graph
        self.known: dict[str, DataFrame | None] = {}
        self.open: list[str] = []
        self.refused: list[DataFrame] = []

    def of(self, table: str) -> DataFrame | None:
        if table not in self.known:
            if table in self.open:
                raise ValueError(f"the foreign keys form a circle: {' - '.join([*self.open, table])}")
            self.open.append(table)
            self.known[table] = self._work_out(table)
            self.open.pop()
        return self.known[table]

    def _work_out(self, table: str) -> DataFrame | None:
        key, df = KEYS[table], self.requested.get(table)
        keys = None if df is None else df.select(F.col(key).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
        for fk in self.graph:
            if keys is not None and fk.parent == table and fk.on_delete == RESTRICT:
                held, gone = self.tables[fk.child], self.of(fk.child)
                if gone is not None:
                    held = held.join(gone, held[KEYS[fk.child]] == gone["id"], "left_anti")
                held = held.select(F.col(fk.column).alias("__held")).where("__held IS NOT NULL").distinct()
                self.refused.append(keys.join(held, F.col("id") == F.col("__held"), "left_semi")
                                    .select(F.lit(table).alias("table_name"), F.col("id").alias("key")))
                keys = keys.join(held, F.col("id") == F.col("__held"), "left_anti")
        brought = []
        for fk in self.graph:
            if fk.child == table and fk.on_delete == CASCADE and self.of(fk.parent) is not None:
                parent = self.of(fk.parent).withColumnRenamed("id", "__gone")
                rows = self.tables[table].select(F.col(key).cast("bigint").alias("id"), F.col(fk.column).alias("__fk"))
                brought.append(rows.join(parent, F.col("__fk") == F.col("__gone"), "left_semi").select("id"))
        if keys is None and not brought:
            return None
        frames = [*([] if keys is None else [keys]), *brought]
        return _union(frames[1:], frames[0]).distinct() if brought else keys


def apply_deletes(r: Roles, sites: DataFrame | None = None, evts: DataFrame | None = None,
                  visitors: DataFrame | None = None, bookings: DataFrame | None = None,
                  guides: DataFrame | None = None, graph: tuple[ForeignKey, ...] = FOREIGN_KEYS) -> DeleteResult:
    """Apply deletes (frames of keys) and their referential actions."""
    spark = r.spark
    deletes = _Deletes(r, {"sites": sites, "evts": evts, "visitors": visitors, "bookings": bookings, "guides": guides}, graph)
    parents = {fk.parent for fk in graph}
    gone = {t: deletes.of(t) for t in ROLE_NAMES if t in parents}
    tables, conflicts = {}, []
    for table, df in r.as_dict().items():
        own = gone.get(table)
        if own is not None:                     # a parent's deleted keys hold what cascades into it
            df = df.join(own.withColumnRenamed("id", "__gone"), F.col(KEYS[table]) == F.col("__gone"), "left_anti")
        hit = [fk for fk in graph if fk.child == table and gone.get(fk.parent) is not None
               and (fk.on_delete == SET_NULL or (fk.on_delete == CASCADE and table not in parents))]
        if hit:
            df, lost = _acted(df, table, hit, {fk.parent: gone[fk.parent] for fk in hit})
            conflicts += lost
        tables[table] = df
    none = spark.createDataFrame([], "table_name string, row_id bigint, nulled_column string")
    return DeleteResult(r.with_tables(**tables), _union(conflicts, none),
                        _union(deletes.refused, spark.createDataFrame([], "table_name string, key bigint")))


def _acted(df: DataFrame, table: str, fks: list[ForeignKey], gone: dict[str, DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """The child table after its actions, and the rows that SET NULL would leave without a target."""
    key = KEYS[table]
    names = [c for c in df.columns]
    cascades = [fk for fk in fks if fk.on_delete == CASCADE]
    if len(fks) == 1 and cascades:              # one key, whole rows go: no row key is needed
        g = gone[fks[0].parent].withColumnRenamed("id", "__gone")
        return df.join(g, F.col(fks[0].column) == F.col("__gone"), "left_anti"), []
    keys = [ids.select(F.lit(p).alias("__parent"), F.col("id").alias("__gone")) for p, ids in gone.items()]
    rows = df.select(F.col(key).alias("__row"), F.explode(F.filter(F.array(*[
        F.struct(F.lit(fk.column).alias("column"), F.lit(fk.parent).alias("parent"), F.col(fk.column).cast("bigint").alias("id"))
        for fk in fks]), lambda c: c["id"].isNotNull())).alias("c"))
    hits = rows.join(_union(keys[1:], keys[0]), (F.col("c.parent") == F.col("__parent")) & (F.col("c.id") == F.col("__gone")),
                     "left_semi").groupBy("__row").agg(F.collect_set("c.column").alias("__hit"))
    j = df.join(hits, F.col(key) == F.col("__row"), "left").withColumn(
        "__hit", F.coalesce("__hit", F.expr("cast(array() as array<string>)")))
    for fk in cascades:
        j = j.where(~F.array_contains("__hit", fk.column))
    nulled = {fk.column for fk in fks if fk.on_delete == SET_NULL}
    j = j.select(*[F.when(~F.array_contains("__hit", c), F.col(c)).alias(c) if c in nulled else F.col(c) for c in names],
                 "__hit")
    lost = []
    if table in ONE_TARGET and nulled:
        bare = (F.size("__hit") > 0) & F.col("site_id").isNull() & F.col("event_id").isNull()
        lost.append(j.where(bare).select(
            F.lit(table).alias("table_name"), F.col(key).alias("row_id"),
            F.when(F.array_contains("__hit", "site_id"), "site_id").otherwise("event_id").alias("nulled_column")))
    return j.drop("__hit"), lost
