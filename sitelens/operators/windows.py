"""Window operators W1 (RANK) and W2 (latest row per key)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


SAMPLE_PER_RANGE = 64                      # values of the sample that sets the range bounds, per range


def _as_number(v: Column, kind: T.DataType) -> Column:
    """A double that never falls as ``v`` rises (equal doubles may stand for different values)."""
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(v, 1, 6).cast("binary").substr(1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(v).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(v.cast("timestamp")).cast("double")
    return v.cast("double")


def rank_by(df: DataFrame, value: str, out: str = "rank", descending: bool = True,
            buckets: int | None = None) -> DataFrame:
    """``RANK() OVER (ORDER BY value [DESC])`` without a one-partition window.

    rank(v) = 1 + number of rows whose value sorts strictly before v.  The
    distinct values are counted (partial aggregate), cut into ``buckets`` value
    ranges by quantiles of a sample, and each range gets its prefix count from
    the ≤``buckets`` range totals plus a running sum inside the range.  Only
    the tiny range-total table is ever ordered globally.  All of it is lazy:
    building the query starts no job.  The approximate number
    of a value only chooses its range; inside a range the values themselves are
    ordered, so wide integers, strings, dates and timestamps rank exactly.
    ``buckets`` defaults to the shuffle partition count.  NULL values rank last
    under DESC and first under ASC, as in MySQL/Spark.
    """
    v = F.col(value)
    buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    # Sort key: larger first for DESC; NULL placed at the end (DESC) / start (ASC).
    num = _as_number(v, df.schema[value].dataType)
    key = F.when(v.isNull(), F.lit(float("inf")) if descending else F.lit(float("-inf"))) \
           .otherwise(-num if descending else num)
    counts = counts.withColumn("__key", key)
    # Range bounds: quantiles of the distinct values with the lowest hashes.  Which values these are
    # depends on the data alone, so every evaluation of this lazy scalar gives the same bounds.
    low = counts.select("__key").orderBy(F.xxhash64("__key"), "__key").limit(SAMPLE_PER_RANGE * buckets)
    quantiles = F.expr(f"transform(sequence(1, {buckets - 1}), i -> try_element_at(s, cast(size(s) * i / {buckets} as int) + 1))")
    bounds = low.select(F.array_sort(F.collect_list("__key")).alias("s")).select(quantiles).scalar()
    counts = counts.withColumn("__bounds", bounds).withColumn(
        "__bucket", F.size(F.filter("__bounds", lambda b: b < F.col("__key")))).drop("__bounds")
    totals = counts.groupBy("__bucket").agg(F.sum("__c").alias("__t"))
    offsets = totals.select(
        "__bucket",
        F.coalesce(F.sum("__t").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    order = v.desc_nulls_last() if descending else v.asc_nulls_first()
    inner = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (counts.withColumn("__before", F.coalesce(F.sum("__c").over(inner), F.lit(0)))
              .join(F.broadcast(offsets), "__bucket")
              .select(F.col(value).alias("__v"), (F.lit(1) + F.col("__off") + F.col("__before"))
                      .cast("bigint").alias(out)))
    return df.join(ranked, v.eqNullSafe(F.col("__v")), "left").drop("__v")


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` tuple per key.

    A ``max(struct(order…, row…))`` aggregate: partial per partition, so a hot
    key never gathers its rows in one task (unlike ``row_number`` over a
    window partition).
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("__m"))
    return agg.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in list(order) + rest]).select(*df.columns)


def top_k_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int,
                    out: str | None = None) -> DataFrame:
    """First ``k`` rows per group under ``order`` (ties broken by ``order`` itself).

    ``row_number() <= k`` lets Spark plan a partial WindowGroupLimit before the
    shuffle, so each map task ships at most k rows per group: a hot group
    costs k × map-partitions rows at its reducer, not the whole group.
    """
    keys = [group] if isinstance(group, str) else list(group)
    rn = out or "__rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    res = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return res if out else res.drop(rn)
