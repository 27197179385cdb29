"""Request tables for the write jobs, derived from the driver tables (FIXTURES.md §3).

Each generator is a Spark projection of ``orders`` / ``customer`` /
``events`` with bad values planted at fixed key residues, so the request
volume grows with the data and every validation branch is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 requests: one per order, shifted past the data so ids are new.

    residues of the order key: %13 = 0 no target, %11 = 0 both targets,
    %17 = 0 unknown site, %7 = 0 guest (name/email, no visitor id), %19 = 0
    guest without email, tickets ∈ {-1..4} (clamped to ≥ 1), mixed-case and
    unknown methods, e-mails of one visitor in different case.
    """
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    part_n = _read(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    ev_n = _read(spark, sf_dir, "events").select(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey")
    guest = (k % 7 == 0)
    site = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, -1 - k) \
        .when((k % 2 == 0) | (k % 11 == 0), F.col("o_custkey") % part_n)
    event = F.when(k % 13 == 0, F.lit(None)).when((k % 2 == 1) | (k % 11 == 0), (k * 3) % ev_n)
    methods = F.array(F.lit("bkash"), F.lit(" NAGAD "), F.lit("card"), F.lit("paypal"), F.lit("Rocket"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(
        k.alias("request_id"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("ts"),
        F.when(~guest, F.col("o_custkey")).alias("visitor_id"),
        F.when(guest, F.col("c_name")).alias("name"),
        F.when(guest & (k % 19 != 0),
               F.when(k % 3 == 0, F.concat("c_name", F.lit("@Example.com")))
               .when(k % 4 == 0, F.concat(F.lit("GUEST"), (k % 500).cast("string"), F.lit("@example.org")))
               .otherwise(F.concat(F.lit("guest"), (k % 500).cast("string"), F.lit("@example.org")))).alias("email"),
        F.when(guest, F.lit("0170000000")).alias("phone"),
        site.cast("bigint").alias("site_id"),
        event.cast("bigint").alias("event_id"),
        ((k % 6) - 1).cast("int").alias("no_of_tickets"),
        F.element_at(methods, (k % 5 + 1).cast("int")).alias("method"),
    )


def payment_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 attempts: one or two per order (retries at %5 = 0), some invalid methods."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    first = o.select((k * 2).alias("request_id"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAY")).alias("ts"),
                     k.alias("booking_id"),
                     F.when(k % 9 == 0, F.lit("paypal")).otherwise(F.lit("card")).alias("method"))
    retry = o.where(k % 5 == 0).select((k * 2 + 1).alias("request_id"),
                                       (F.col("o_orderdate") + F.expr("INTERVAL 3 DAY")).alias("ts"),
                                       k.alias("booking_id"), F.lit(" BKash").alias("method"))
    return first.unionByName(retry)


def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 requests from 'purchase' events: ratings out of range, missing or double targets."""
    e = _read(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    part_n = _read(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    k = F.col("event_id")
    none = k % 13 == 0
    return e.select(
        k.alias("request_id"), F.col("ts"), F.col("user_id").alias("visitor_id"),
        F.when(~none & (k % 2 == 0), k % part_n).alias("site_id"),
        F.when(~none & ((k % 2 == 1) | (k % 9 == 0)), k).alias("event_id"),
        F.when(k % 10 == 0, F.lit(None)).otherwise((k % 8) - 1).cast("int").alias("rating"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit(" review  ")).alias("comment"),
    )


def signup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 requests from customers: duplicate emails (case variants), bad formats, blanks."""
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    email = F.when(k % 23 == 0, F.lit("not-an-email")) \
        .when(k % 5 == 0, F.concat(F.upper(F.lit("Dup")), (k % 40).cast("string"), F.lit("@Example.net  "))) \
        .otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit("@example.net")))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        k.alias("request_id"), F.expr("TIMESTAMP_NTZ'2002-01-01 00:00:00'") .alias("ts"),
        F.when(k % 29 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_name"))).alias("full_name"),
        email.alias("email"), F.lit("0180000000").alias("phone"), F.col("n_name").alias("nationality"))


def contact_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 contact messages from customers (some blank)."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("request_id"), F.expr("TIMESTAMP_NTZ'2002-01-01 00:00:00'").alias("ts"),
                    F.col("c_name").alias("name"),
                    F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.lower("c_name"), F.lit("@example.com")))
                    .alias("email"),
                    F.when(k % 4 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" Hello from "), F.col("c_mktsegment")))
                    .alias("message"))


def method_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 new payment-method proposals from market segments (valid, duplicate, malformed)."""
    c = _read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    seg = F.lower(F.col("c_mktsegment"))
    return c.select(F.concat(F.lit("wallet_"), seg).alias("code"),
                    F.concat(F.lit("Wallet "), F.col("c_mktsegment")).alias("label")).unionByName(
        c.select(F.concat(F.lit("Bad Code "), seg).alias("code"), F.lit("x").alias("label")))


def retried_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 requests: M1's, every fourth sent again ten minutes later and every eighth once more after that."""
    q = booking_requests(spark, sf_dir)
    again = q.where(F.col("request_id") % 4 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    third = q.where(F.col("request_id") % 8 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 20 MINUTES"))
    return q.unionByName(again).unionByName(third)


def site_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 changes of the sites table: new prices, names and deletions, several for some sites, and new sites.

    residues of the part key: %5 = 0 an earlier price that a later change overrides, %3 = 0 a price of 1.25
    times the old one without a description (the old one stays), %12 = 0 deleted after that, %10 = 1 a new site.
    """
    p = _read(spark, sf_dir, "part")
    n = p.select(F.max("p_partkey")).scalar()
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(10,2)")

    def change(cond, op, day, key, name, amount, text):
        return p.where(cond).select(
            key.cast("bigint").alias("site_id"), F.lit(op).alias("op"), F.lit(f"2002-01-{day:02d}").cast("date").alias("ts"),
            name.alias("name"), F.col("p_brand").alias("location"), F.col("p_type").alias("type"),
            amount.cast("decimal(10,2)").alias("ticket_price"), F.lit("Tentative").alias("unesco_status"),
            text.cast("string").alias("description"), F.lit("2002-01-01").cast("date").alias("created_at"),
            F.lit(None).cast("string").alias("opening_hours"))
    none = F.lit(None)
    return (change(k % 5 == 0, "upsert", 1, k, F.col("p_name"), F.lit(1), F.lit("overridden"))
            .unionByName(change((k % 5 == 0) | (k % 3 == 0), "upsert", 2, k, F.upper("p_name"), price * F.lit(1.25).cast("decimal(3,2)"), none))
            .unionByName(change(k % 12 == 0, "delete", 3, k, none.cast("string"), none, none))
            .unionByName(change(k % 10 == 1, "upsert", 4, k + n + 1, F.concat(F.lit("new "), F.col("p_name")), price, F.lit("new"))))
