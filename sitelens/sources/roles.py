"""Role tables.

The engine works on eight role tables (sites, evts, visitors, bookings,
payments, guides, assignments, reviews).  ``load_roles`` derives them from the
driver's TPC-H-like Parquet tables with the mapping of FIXTURES.md §2; a real
deployment would instead point ``Roles`` at its own Parquet tables with the
declared schemas in ``ROLE_SCHEMAS``.

Everything is lazy: the role frames are plain projections/joins over the scans,
so Catalyst prunes columns and pushes filters of each query down to Parquet.
The table sizes used by the key derivation (``count(part)`` etc.) are scalar
subqueries, evaluated once per query by Spark, never collected by us.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEC = T.DecimalType(10, 2)

# Fixed reference dates ("now") for the driver data: FIXTURES.md §2.
AS_OF_SALES = dt.date(2001, 8, 1)    # bookings, payments
AS_OF_EVENTS = dt.date(2024, 1, 15)  # events, reviews

ROLE_SCHEMAS: dict[str, T.StructType] = {
    "sites": T.StructType([
        T.StructField("site_id", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("location", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("ticket_price", DEC), T.StructField("unesco_status", T.StringType()),
        T.StructField("description", T.StringType()), T.StructField("created_at", T.DateType()),
        T.StructField("opening_hours", T.StringType())]),
    "evts": T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("site_id", T.LongType()),
        T.StructField("name", T.StringType()), T.StructField("event_date", T.DateType()),
        T.StructField("ticket_price", DEC), T.StructField("capacity", T.LongType()),
        T.StructField("description", T.StringType()), T.StructField("event_time", T.StringType())]),
    "visitors": T.StructType([
        T.StructField("visitor_id", T.LongType()), T.StructField("full_name", T.StringType()),
        T.StructField("nationality", T.StringType()), T.StructField("email", T.StringType()),
        T.StructField("created_at", T.DateType()), T.StructField("phone", T.StringType())]),
    "bookings": T.StructType([
        T.StructField("booking_id", T.LongType()), T.StructField("visitor_id", T.LongType()),
        T.StructField("site_id", T.LongType()), T.StructField("event_id", T.LongType()),
        T.StructField("booking_date", T.TimestampNTZType()), T.StructField("no_of_tickets", T.LongType()),
        T.StructField("booked_ticket_price", DEC), T.StructField("payment_status", T.StringType())]),
    "payments": T.StructType([
        T.StructField("payment_id", T.LongType()), T.StructField("booking_id", T.LongType()), T.StructField("attempt_no", T.LongType()),
        T.StructField("acquirer_id", T.LongType()), T.StructField("amount", DEC),
        T.StructField("method", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("paid_at", T.TimestampNTZType())]),
    "guides": T.StructType([
        T.StructField("guide_id", T.LongType()), T.StructField("full_name", T.StringType()),
        T.StructField("language", T.StringType()), T.StructField("specialization", T.StringType()),
        T.StructField("salary", DEC)]),
    "assignments": T.StructType([
        T.StructField("assign_id", T.LongType()), T.StructField("guide_id", T.LongType()),
        T.StructField("site_id", T.LongType()), T.StructField("event_id", T.LongType()),
        T.StructField("shift_time", T.StringType())]),
    "reviews": T.StructType([
        T.StructField("review_id", T.LongType()), T.StructField("visitor_id", T.LongType()),
        T.StructField("site_id", T.LongType()), T.StructField("event_id", T.LongType()),
        T.StructField("rating", T.IntegerType()), T.StructField("comment", T.StringType()),
        T.StructField("review_date", T.DateType())]),
}

ROLE_NAMES = tuple(ROLE_SCHEMAS)


@dataclass(frozen=True)
class Roles:
    """The eight role DataFrames plus the fixed 'now' of each domain."""

    sites: DataFrame
    evts: DataFrame
    visitors: DataFrame
    bookings: DataFrame
    payments: DataFrame
    guides: DataFrame
    assignments: DataFrame
    reviews: DataFrame
    as_of_sales: dt.date = AS_OF_SALES
    as_of_events: dt.date = AS_OF_EVENTS
    extra: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.sites.sparkSession

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ROLE_NAMES}

    def with_tables(self, **tables: DataFrame) -> "Roles":
        return replace(self, **tables)

    def collated(self, collation: str = "UNICODE_CI_AI") -> "Roles":
        """The roles with every text column under a collation, by default without case and accents.

        Comparison, search, joins, DISTINCT, set operations, grouping and order on a text
        then follow the collation, in every query and without a change to it; Spark shuffles
        and groups such columns by their collation keys.
        """
        def cast(df: DataFrame) -> DataFrame:
            return df.select(*[F.collate(f"`{f.name}`", collation).alias(f.name) if isinstance(f.dataType, T.StringType)
                               else F.col(f"`{f.name}`") for f in df.schema])
        return self.with_tables(**{n: cast(df) for n, df in self.as_dict().items()})

    def register_views(self) -> None:
        """Expose the roles as temp views for SQL users (``spark.sql``)."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(branches: list[tuple[Column, object]], default: object) -> Column:
    """CASE WHEN c1 THEN v1 WHEN c2 THEN v2 … ELSE d END, as nested null-safe IFs.

    Same result as the CASE (a NULL condition falls through either way), but
    written so that Catalyst reduces a filter such as ``status = 'successful'``
    to ``l_returnflag <=> 'A'``, which is pushed into the Parquet scan.
    """
    out = F.lit(default)
    for cond, val in reversed(branches):
        out = F.when(cond, F.lit(val)).otherwise(out)
    return out


def _day(base: str, offset: Column) -> Column:
    return F.date_add(F.lit(base).cast("date"), offset.cast("int"))


def load_roles(spark: SparkSession, sf_dir: str) -> Roles:
    """Build the role views over the driver Parquet tables (FIXTURES.md §2)."""
    part = _read(spark, sf_dir, "part")
    supplier = _read(spark, sf_dir, "supplier")
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    events = _read(spark, sf_dir, "events")

    # Table sizes as lazy scalar subqueries (one tiny aggregate each).
    n_part = part.select(F.count(F.lit(1))).scalar()
    n_events = events.select(F.count(F.lit(1))).scalar()
    n_guides_used = supplier.select(F.floor(F.count(F.lit(1)) * F.lit(0.9)).cast("bigint")).scalar()

    sites = part.select(
        F.col("p_partkey").alias("site_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("location"),
        F.col("p_type").alias("type"),
        F.col("p_retailprice").cast(DEC).alias("ticket_price"),
        F.when(F.col("p_size") % 10 == 0, "World Heritage")
         .when(F.col("p_size") % 10 < 4, "Tentative").otherwise("None").alias("unesco_status"),
        F.concat("p_name", F.lit(" "), "p_type").alias("description"),
        _day("1995-01-01", F.col("p_partkey")).alias("created_at"),
        F.when(F.col("p_size") % 3 == 0, "09:00-17:00").when(F.col("p_size") % 3 == 1, "10:00-18:00").alias("opening_hours"),
    )

    evts = events.select(
        "event_id",
        F.col("user_id").alias("site_id"),
        F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("name"),
        F.col("ts").cast("date").alias("event_date"),
        F.col("value").cast(DEC).alias("ticket_price"),
        F.col("user_id").alias("capacity"),
        F.col("event_type").alias("description"),
        F.date_format("ts", "HH:mm:ss").alias("event_time"),
    )

    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcast.
    visitors = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("visitor_id"),
        F.col("c_name").alias("full_name"),
        F.col("n_name").alias("nationality"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        _day("1995-01-01", F.col("c_custkey")).alias("created_at"),
        F.concat(F.lit("017"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"),
    )

    ok = F.col("o_orderkey")
    bookings = orders.select(
        ok.alias("booking_id"),
        F.col("o_custkey").alias("visitor_id"),
        F.when(ok % 3 != 0, F.col("o_custkey") % n_part).alias("site_id"),
        F.when(ok % 3 == 0, (ok * 7) % n_events).alias("event_id"),
        F.col("o_orderdate").alias("booking_date"),
        (F.lit(1) + ok % 5).alias("no_of_tickets"),
        F.col("o_totalprice").cast(DEC).alias("booked_ticket_price"),
        _case([(F.col("o_orderstatus").eqNullSafe("F"), "paid"), (F.col("o_orderstatus").eqNullSafe("O"), "pending")],
              "failed").alias("payment_status"),
    )

    ln = F.col("l_linenumber")
    payments = lineitem.select(
        # An order's lines are told apart by number, supplier and price; no other column is a key.
        (F.col("l_orderkey") * (1 << 32) + F.conv(F.substring(F.md5(F.concat_ws("/", ln, "l_suppkey", F.col(
            "l_extendedprice").cast(DEC)).cast("binary")), 1, 8), 16, 10).cast("bigint")).alias("payment_id"),
        F.col("l_orderkey").alias("booking_id"),
        ln.alias("attempt_no"),
        F.col("l_suppkey").alias("acquirer_id"),
        F.col("l_extendedprice").cast(DEC).alias("amount"),
        _case([(ln.eqNullSafe(1), "bkash"), (ln.eqNullSafe(2), "nagad"), (ln.eqNullSafe(3), "rocket"),
               (ln.eqNullSafe(4), "card")], "bank_transfer").alias("method"),
        _case([(F.col("l_returnflag").eqNullSafe("A"), "successful"), (F.col("l_returnflag").eqNullSafe("N"), "initiated"),
               (F.col("l_linestatus").eqNullSafe("F"), "failed")], "refunded").alias("status"),
        F.col("l_shipdate").alias("paid_at"),
    )

    guides = (supplier
              .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("s_suppkey").alias("guide_id"), F.col("s_name").alias("full_name"),
                      F.col("n_name").alias("language"), F.col("r_name").alias("specialization"),
                      F.col("s_acctbal").cast(DEC).alias("salary")))

    pk = F.col("p_partkey")
    assignments = part.select(
        pk.alias("assign_id"),
        (pk % n_guides_used).alias("guide_id"),
        F.when(pk % 3 != 0, pk).alias("site_id"),
        F.when(pk % 3 == 0, pk).alias("event_id"),
        F.when(F.col("p_size") % 3 == 0, "Morning").when(F.col("p_size") % 3 == 1, "Afternoon")
         .otherwise("Evening").alias("shift_time"),
    )

    eid = F.col("event_id")
    reviews = events.where(F.col("event_type").isin("view", "click")).select(
        eid.alias("review_id"),
        F.col("user_id").alias("visitor_id"),
        F.when(eid % 4 != 0, (eid * 13) % n_part).alias("site_id"),
        F.when(eid % 4 == 0, (eid * 11) % n_events).alias("event_id"),
        (F.lit(1) + eid % 5).cast("int").alias("rating"),
        F.col("event_type").alias("comment"),
        F.col("ts").cast("date").alias("review_date"),
    )

    extra = {"sf_dir": sf_dir}
    try:   # only the full-text queries over documents need it
        extra["documents"] = _read(spark, sf_dir, "documents")
    except Exception:  # noqa: BLE001 - table absent from this folder
        pass
    return Roles(sites=sites, evts=evts, visitors=visitors, bookings=bookings, payments=payments,
                 guides=guides, assignments=assignments, reviews=reviews, extra=extra)


def roles_from_tables(spark: SparkSession, tables: dict[str, DataFrame], **kw) -> Roles:
    """Roles over tables that already have the role schemas (e.g. the seed fixture)."""
    return Roles(**{n: tables[n] for n in ROLE_NAMES}, **kw)


def read_roles(spark: SparkSession, path: str, **kw) -> Roles:
    """Roles stored as one Parquet folder per role under ``path``."""
    return Roles(**{n: spark.read.schema(ROLE_SCHEMAS[n]).parquet(f"{path.rstrip('/')}/{n}")
                    for n in ROLE_NAMES}, **kw)


# Bucketing of stored role tables: the join key each table meets most often.
# bookings and payments share booking_id, so their join needs no shuffle.
ROLE_BUCKETS = {"sites": "site_id", "evts": "event_id", "visitors": "visitor_id", "bookings": "booking_id",
                "payments": "booking_id", "guides": "guide_id", "assignments": "guide_id", "reviews": "visitor_id"}


def save_roles(roles: Roles, database: str, buckets: int, mode: str = "overwrite") -> None:
    """Store the role tables as bucketed, sorted catalog tables in ``database``.

    Tables bucketed on the same key with the same bucket count join without
    an exchange (sort-merge join on co-located buckets).  Choose ``buckets``
    so one bucket of the largest table fits a task (e.g. total size / 512 MB).
    """
    spark = roles.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in roles.as_dict().items():
        key = ROLE_BUCKETS[name]
        (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
         .saveAsTable(f"{database}.{name}"))


def table_roles(spark: SparkSession, database: str, **kw) -> Roles:
    """Roles over the catalog tables written by ``save_roles``."""
    return Roles(**{n: spark.table(f"{database}.{n}") for n in ROLE_NAMES}, **kw)
