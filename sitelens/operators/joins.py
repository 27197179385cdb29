"""Join operators J1–J18.

Design notes for scale:

* Equi joins are left to Catalyst/AQE: a side is broadcast only when Spark's
  size statistics put it under ``spark.sql.autoBroadcastJoinThreshold`` (the
  size check), otherwise sort-merge; AQE re-plans at runtime and splits skewed
  partitions.  Explicit ``broadcast()`` is used only for inputs with a proven
  bound (a LIMIT k result, a one-row aggregate, a fixed domain list).
* Left joins on a nullable foreign key (XOR targets: a booking points at a
  site *or* an event) would hash every NULL key into one reducer.  ``lookup``
  spreads NULL keys over ``null_buckets`` salt values so they never pile up.
* NOT IN (J14) is built from a sort-merge anti join plus one scalar
  aggregate (row count, non-NULL key count) instead of Spark's null-aware
  anti join, which needs a broadcastable build side.
* Self joins never list a hot group's pairs in one task: bounded top-k pairs
  use a ≤k broadcast probe; full answers are pair counts per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salt_count(df: DataFrame) -> int:
    """How many salts spread rows without a key: as many as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cols(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _right_keys(right: DataFrame, right_key: str) -> DataFrame:
    """Distinct non-NULL keys of the probe side.

    Only existence matters for semi/anti joins, so the keys are deduplicated
    first: the partial aggregate ships each key once per map task, and a key
    holding a third of the right side never floods one reducer (AQE can only
    split the left side of a semi/anti join).
    """
    return right.select(F.col(right_key).alias("__k")).where(F.col("__k").isNotNull()).distinct()


def semi(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Column,
         right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` with a match in ``right`` (IN / EXISTS)."""
    if right_key is not None:
        return left.join(_right_keys(right, right_key), F.col(on) == F.col("__k"), "left_semi")
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Column,
         right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` without a match (NOT EXISTS, LEFT JOIN … IS NULL)."""
    if right_key is not None:
        return left.join(_right_keys(right, right_key), F.col(on) == F.col("__k"), "left_anti")
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``left_key NOT IN (SELECT right_key FROM right)`` with SQL NULL rules.

    * right empty            → every left row (even NULL keys);
    * right holds a NULL key → no row at all;
    * otherwise              → non-NULL left keys without a match.
    The match is a shuffle anti join; the guards come from one scalar aggregate.
    """
    rk = right.select(F.col(right_key).alias("__k"))
    # One pass over the right side: (row count, non-NULL key count) as one scalar.
    guard = rk.select(F.struct(F.count(F.lit(1)).alias("n"), F.count("__k").alias("nn"))).scalar()
    n_rows, n_nonnull = guard.getField("n"), guard.getField("nn")
    kept = left.join(_right_keys(right, right_key), F.col(left_key) == F.col("__k"), "left_anti")
    return kept.where((n_rows == 0) | (F.col(left_key).isNotNull() & (n_rows == n_nonnull)))


def _spread_key(key: Column, buckets: int, salt_src: Column) -> tuple[Column, Column]:
    """Join key pair (key, salt): NULL keys get a salt 1..buckets so they spread."""
    salt = F.when(key.isNull(), F.pmod(F.xxhash64(salt_src), F.lit(buckets)) + 1).otherwise(F.lit(0))
    return key, salt


def lookup(facts: DataFrame, dim: DataFrame, fk: str, pk: str, cols: dict[str, str],
           salt_by: str | None = None, null_buckets: int | None = None) -> DataFrame:
    """Left join ``facts.fk = dim.pk`` adding ``dim`` columns renamed by ``cols``.

    ``cols`` maps dim column → output name.  When ``salt_by`` names a
    high-cardinality fact column, rows with a NULL ``fk`` are spread over
    ``null_buckets`` partitions instead of one (they can never match); the default
    follows the session's shuffle partitions.
    """
    d = dim.select(F.col(pk).alias("__pk"), *[F.col(k).alias(v) for k, v in cols.items()])
    if salt_by is None:
        return facts.join(d, F.col(fk) == F.col("__pk"), "left").drop("__pk")
    _, salt = _spread_key(F.col(fk), null_buckets or salt_count(facts), F.col(salt_by))
    f = facts.withColumn("__salt", salt)
    # Salt 0 on the dimension side, written as an expression of the key: a
    # literal 0 would be constant-folded out of the join keys (becoming a
    # residual filter) and the shuffle would partition on the key alone.
    d = d.withColumn("__dsalt", F.when(F.col("__pk").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    out = f.join(d, (F.col(fk) == F.col("__pk")) & (F.col("__salt") == F.col("__dsalt")), "left")
    return out.drop("__pk", "__salt", "__dsalt")


def _first_and_fallback(facts: DataFrame, sites: DataFrame, evts: DataFrame, site_col: str, event_col: str,
                        salt_by: str | None, always: bool) -> DataFrame:
    """``facts`` with ``__first`` (name of the first target) and ``__second`` (event name of a row with two targets).

    Candidates in order of priority: the site, then the event.  All first candidates
    meet the union of both name tables on (kind, id) in one join.  Only a row that
    breaks the XOR rule has a second candidate; it is looked up among the events - for
    every such row (``always``), or only where the first candidate dangles.  The second
    key is NULL on all other rows, and NULL keys are dealt out by salt, so the fact
    table is read once and no reducer gathers the rows without a key.
    """
    names = (sites.select(F.lit(0).alias("__tk"), F.col("site_id").cast("bigint").alias("__tid"),
                          F.col("name").alias("__first"))
             .unionByName(evts.select(F.lit(1).alias("__tk"), F.col("event_id").cast("bigint").alias("__tid"),
                                      F.col("name").alias("__first"))))
    names = names.withColumn("__nsalt", F.when(F.col("__tid").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    spread = F.col(salt_by) if salt_by else F.struct(*[F.col(c) for c in facts.columns])
    buckets = salt_count(facts)
    f = (facts.withColumn("__fk", F.when(F.col(site_col).isNotNull(), F.lit(0))
                          .when(F.col(event_col).isNotNull(), F.lit(1)))
         .withColumn("__fid", F.coalesce(F.col(site_col), F.col(event_col)).cast("bigint")))
    f = f.withColumn("__salt", _spread_key(F.col("__fid"), buckets, spread)[1])
    f = f.join(names, (F.col("__fk") == F.col("__tk")) & (F.col("__fid") == F.col("__tid"))
               & (F.col("__salt") == F.col("__nsalt")), "left")
    open_ = F.col(site_col).isNotNull() & (F.lit(True) if always else F.col("__first").isNull())
    f = f.withColumn("__sid", F.when(open_, F.col(event_col)))
    f = f.withColumn("__salt", _spread_key(F.col("__sid"), buckets, spread)[1])
    second = evts.select(F.col("event_id").alias("__eid"), F.col("name").alias("__second"))
    second = second.withColumn("__esalt", F.when(F.col("__eid").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    f = f.join(second, (F.col("__sid") == F.col("__eid")) & (F.col("__salt") == F.col("__esalt")), "left")
    return f.drop("__fk", "__fid", "__tk", "__tid", "__salt", "__nsalt", "__sid", "__eid", "__esalt")


def resolve_target(facts: DataFrame, sites: DataFrame, evts: DataFrame,
                   site_col: str = "site_id", event_col: str = "event_id",
                   out: str = "target_name", kind: str | None = "target_kind",
                   salt_by: str | None = None) -> DataFrame:
    """Polymorphic target (site XOR event) → one name plus its kind.

    ``COALESCE(site.name, event.name)`` as the reference computes it, in one plan over
    the fact table: a row that breaks the XOR rule and whose site dangles still falls
    back to the event's name (see :func:`_first_and_fallback`).
    """
    f = _first_and_fallback(facts, sites, evts, site_col, event_col, salt_by, always=False)
    f = f.withColumn(out, F.coalesce("__first", "__second"))
    if kind:
        f = f.withColumn(kind, F.when(F.col("__first").isNotNull() & F.col(site_col).isNotNull(), "site")
                         .when(F.col(out).isNotNull(), "event"))
    return f.drop("__first", "__second")


def _pair_residual(op: str, lid: Column, rid: Column) -> Column:
    if op == "<>":
        return lid != rid
    if op == "<":
        return lid < rid
    raise ValueError(f"unsupported pair residual {op!r}")


def top_pairs(df: DataFrame, key: str, id_col: str, left_cols: dict[str, str],
              right_cols: dict[str, str], op: str, order: list[Column], k: int,
              right_order: list[Column] | None = None) -> DataFrame:
    """J8 bounded: the first ``k`` pairs of a self join on ``key`` with residual ``op``.

    The output order is ``order`` (over left columns) then the right id.  Only
    left rows that have a partner can start a pair; the first ``k`` such rows
    (a TakeOrdered, ≤k rows, safe to broadcast) are probed against the table,
    so no group's full pair set is ever built.  Work is linear in the table.
    """
    stats = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max(id_col).alias("__mx"))
    has_partner = (F.col("__n") > 1) if op == "<>" else (F.col(id_col) < F.col("__mx"))
    left = (df.join(stats, key).where(has_partner)
            .select(*[F.col(c).alias(a) for c, a in left_cols.items()], F.col(key).alias("__lk"),
                    F.col(id_col).alias("__lid")))
    first = left.orderBy(*order, F.col("__lid")).limit(k)
    right = df.select(*[F.col(c).alias(a) for c, a in right_cols.items()], F.col(key).alias("__rk"),
                      F.col(id_col).alias("__rid"))
    pairs = F.broadcast(first).join(
        right, (F.col("__lk") == F.col("__rk")) & _pair_residual(op, F.col("__lid"), F.col("__rid")))
    return (pairs.orderBy(*order, F.col("__lid"), *(right_order or []), F.col("__rid")).limit(k)
            .drop("__lk", "__rk", "__lid", "__rid"))


def pair_counts(df: DataFrame, key: str, op: str, n_out: str = "n", pairs_out: str = "n_pairs") -> DataFrame:
    """J8 in bulk: per value of ``key`` the rows and the pairs its self join has.

    ``op`` "<>" counts ordered pairs, "<" each pair once (the residual compares a
    unique id).  The pair list itself grows with the square of a group, so it is only
    listed under a limit (:func:`top_pairs`).  NULL keys match nothing; groups of one
    row have no pair and are left out, as an inner join leaves them out.
    """
    n = F.col(n_out)
    pairs = {"<>": n * (n - 1), "<": (n * (n - 1) / 2).cast("bigint")}[op]
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n_out))
            .where(n > 1).withColumn(pairs_out, pairs))


def bounded_product(left: DataFrame, right: DataFrame, k_left: int, k_right: int,
                    left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Cross product of the first ``k_left`` × ``k_right`` rows.

    Both inputs are cut by a LIMIT first, so the product has at most
    k_left·k_right rows and the broadcast side is bounded by ``k_right``.
    """
    l = left.orderBy(*left_order).limit(k_left)
    r = right.orderBy(*right_order).limit(k_right)
    return l.crossJoin(F.broadcast(r))


def left_expand(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key`` for a many-side ``right``.

    Built as (inner join) ∪ (left rows without a match, right columns NULL).
    AQE can split a skewed partition on both sides of an inner join but only
    on the preserved side of a left outer join, so a right-side key holding a
    third of the rows would otherwise stay in one reducer.  Column names of
    ``left`` and ``right`` must be disjoint.
    """
    matched = left.join(right, F.col(left_key) == F.col(right_key))
    lonely = anti(left, right, left_key, right_key=right_key).select(
        *left.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    return matched.unionByName(lonely)


def bounded(df: DataFrame, k: int | None) -> DataFrame:
    """Broadcast hint for a frame proven to hold at most ``k`` rows (a LIMIT k result
    joined to primary keys); without a bound (``k`` None) Spark's size check decides.

    Joining a top-k result to a large table then streams the large table
    map-side against the broadcast rows: the large table is never shuffled.
    """
    return df if k is None else F.broadcast(df)


def target_names(facts: DataFrame, sites: DataFrame, evts: DataFrame, site_out: str = "site_name",
                 event_out: str = "event_name", site_col: str = "site_id", event_col: str = "event_id",
                 salt_by: str | None = None) -> DataFrame:
    """Both target names side by side (site name, event name) in one plan over the fact table.

    The joins of :func:`resolve_target`; rows with both targets set (XOR violations)
    get both names.
    """
    f = _first_and_fallback(facts, sites, evts, site_col, event_col, salt_by, always=True)
    return (f.withColumn(site_out, F.when(F.col(site_col).isNotNull(), F.col("__first")))
            .withColumn(event_out, F.when(F.col(site_col).isNull(), F.col("__first")).otherwise(F.col("__second")))
            .drop("__first", "__second"))


def bounded_lookup(top: DataFrame, k: int | None, dim: DataFrame, fk: str, pk: str, cols: dict[str, str]) -> DataFrame:
    """:func:`lookup` for a frame of at most ``k`` rows (a LIMIT k result).

    The dimension is cut to the keys of the ≤k rows by a broadcast semi join
    (streamed map-side, never shuffled) and the left join then meets only that
    tiny remainder.  Nothing runs while the query is built.  Without a bound
    (``k`` None) it is the plain lookup.
    """
    if k is None:
        return lookup(top, dim, fk, pk, cols)
    keys = top.select(F.col(fk).alias("__bk")).where(F.col("__bk").isNotNull()).distinct()
    small = dim.join(F.broadcast(keys), F.col(pk) == F.col("__bk"), "left_semi")
    return lookup(top, F.broadcast(small), fk, pk, cols)
