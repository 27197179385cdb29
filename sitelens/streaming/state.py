"""Keyed state of the intake streams (T1 guests, T2 settlements).

What the stored tables say of a key (a booking's price and latest payment, the visitor
of an e-mail) is joined to the stream from a copy made at its first start.  State holds
only what the stream itself has to remember: which stored bookings it has settled
(``dropDuplicates``), and bookings and visitors that are not stored, one small value per
key (``transformWithState``).  A micro-batch touches the state of its own keys only, so
its work does not grow with the batches before it.  State is versioned with the query's
checkpoint: a batch that is replayed after a failure finds the state it started from and
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitelens.jobs.intake import ALLOWED_METHODS
from sitelens.operators.windows import latest_per_key
from sitelens.sources.roles import Roles

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; a session that names another provider is told so."""
    key = "spark.sql.streaming.stateStore.providerClass"
    named = spark.conf.get(key, None)
    if named not in (None, "", ROCKSDB) and "HDFSBackedStateStoreProvider" not in named:
        raise ValueError(f"{key} is {named}; the intake streams need {ROCKSDB}")
    spark.conf.set(key, ROCKSDB)


# ---------------------------------------------------------------- T2 settlements

LATEST = ["paid_at", "attempt_no", "acquirer_id", "amount", "method", "status", "payment_id"]
SETTLEMENT_IN = ("kind string, booking_id bigint, request_id bigint, ts timestamp, method string, "
                 "price decimal(10,2), payment_status string")
SETTLEMENT_OUT = ("booking_id bigint, request_id bigint, ts timestamp, reject_reason string, method string, "
                  "price decimal(10,2), change string, payment_id bigint, attempt_no bigint, acquirer_id bigint, "
                  "status string")


class Settlement(StatefulProcessor):
    """Per booking made after the start: its price and whether it is paid."""

    def __init__(self, first_key: int):
        self.first_key = first_key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.booking = handle.getValueState("booking", "price decimal(10,2), payment_status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.booking.get()
        attempts = []
        for r in rows:
            if r.kind == "attempt":
                attempts.append(r)
            elif known is None:
                known = (r.price, r.payment_status)
                self.booking.update(known)
        for a in sorted(attempts, key=lambda r: (r.ts, r.request_id)):
            reason, change, out = None, None, (None, None, None)
            if known is None:
                reason = "booking_not_found"
            elif a.method not in ALLOWED_METHODS:
                reason = "invalid_method"
            elif known[1] == "paid":
                reason = "already_paid"
            elif known[0] is not None and known[0] <= 0:
                reason = "invalid_amount"
            else:                                               # the booking gets its first payment
                change, out = "insert", (self.first_key + a.request_id, 1, "initiated")
                known = (known[0], "paid")
                self.booking.update(known)
            yield Row(booking_id=key[0], request_id=a.request_id, ts=a.ts, reject_reason=reason, method=a.method,
                      price=known[0] if known else None, change=change, payment_id=out[0], attempt_no=out[1],
                      acquirer_id=None, status=out[2])

    def close(self) -> None:
        pass


def booking_states(r: Roles) -> DataFrame:
    """Every stored booking with its latest payment's identity, one row per booking."""
    latest = latest_per_key(r.payments.select("booking_id", *LATEST), "booking_id", LATEST)
    latest = latest.select(F.col("booking_id").alias("__b"), "payment_id", "attempt_no", "acquirer_id")
    b = r.bookings.select("booking_id", F.col("booked_ticket_price").alias("price"), "payment_status")
    return (latest_per_key(b, "booking_id", ["price", "payment_status"])
            .join(latest, F.col("booking_id") == F.col("__b"), "left")
            .select("booking_id", "price", "payment_status", "payment_id",
                    F.col("attempt_no").cast("bigint").alias("attempt_no"),
                    F.col("acquirer_id").cast("bigint").alias("acquirer_id")))


def _as_input(df: DataFrame, kind: str, **given: Column) -> DataFrame:
    """Rows of :class:`Settlement`; columns that are not given are NULL."""
    want = [f.strip().split(" ", 1) for f in SETTLEMENT_IN.replace("(10,2)", "(10;2)").split(",")]
    return df.select(*[given.get(n, F.lit(None)).cast(t.replace(";", ",")).alias(n) if n != "kind"
                       else F.lit(kind).alias("kind") for n, t in want])


def settle(attempts: DataFrame, states: DataFrame, first_key: int, bookings: DataFrame | None = None) -> DataFrame:
    """Outcomes of a stream's attempts, which :func:`decided` completes per micro-batch.

    An attempt that could settle a stored booking is ``open``.  So is the one row per
    booking, ``first``, that marks the micro-batch in which such an attempt comes first: it
    belongs to the booking's whole batch, whichever attempt left it, so the batch may order
    its attempts.  ``bookings`` is a stream of bookings made meanwhile; attempts for them
    are settled by :class:`Settlement`.  A new payment's key is ``first_key`` plus its
    request's id, as in the batch job.
    """
    stored = states.withColumnRenamed("booking_id", "__b").withColumn("__stored", F.lit(True))
    a = (attempts.select("booking_id", "request_id", "ts", F.lower(F.trim("method")).alias("method"))
         .join(stored, F.col("booking_id").eqNullSafe(F.col("__b")), "left"))
    known, old = F.col("__stored").isNotNull(), F.col("payment_id").isNotNull()
    reason = (F.when(~known, "booking_not_found")
              .when(~F.coalesce(F.col("method").isin(*ALLOWED_METHODS), F.lit(False)), "invalid_method")
              .when(F.col("payment_status") == "paid", "already_paid")
              .when(F.col("price") <= 0, "invalid_amount"))
    # The latest payment is settled; a booking without one gets its first.
    a = a.withColumn("reject_reason", reason)
    a = a.select("booking_id", "request_id", "ts", "reject_reason", "method", "price",
                 F.when(old, "update").otherwise("insert").alias("change"),
                 F.coalesce("payment_id", F.lit(first_key) + F.col("request_id")).alias("payment_id"),
                 F.when(old, F.col("attempt_no")).otherwise(F.lit(1).cast("bigint")).alias("attempt_no"), "acquirer_id",
                 F.when(old, "successful").otherwise("initiated").alias("status"),
                 F.col("reject_reason").isNull().alias("open"), F.lit(False).alias("first"), known.alias("__known"))
    marks = a.where("open").select("booking_id").dropDuplicates(["booking_id"]).select(
        "booking_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in a.schema if f.name not in
                        ("booking_id", "open", "first", "__known")], F.lit(True).alias("open"), F.lit(True).alias("first"))
    if bookings is None:
        return a.drop("__known").unionByName(marks)
    here = bookings.join(stored, bookings["booking_id"].eqNullSafe(F.col("__b")), "left_anti")
    rows = _as_input(a.where(~F.col("__known")), "attempt", booking_id=F.col("booking_id"), request_id=F.col("request_id"),
                     ts=F.col("ts"), method=F.col("method")).unionByName(
        _as_input(here, "booking", booking_id=F.col("booking_id"), price=F.col("booked_ticket_price"),
                  payment_status=F.col("payment_status")))
    later = rows.groupBy("booking_id").transformWithState(Settlement(first_key), SETTLEMENT_OUT, "append", "none")
    return (a.where("__known").drop("__known").unionByName(marks)
            .unionByName(later.withColumn("open", F.lit(False)).withColumn("first", F.lit(False))))


def decided(batch: DataFrame) -> DataFrame:
    """One outcome per attempt of a micro-batch of :func:`settle`.

    In the batch that has a booking's ``first`` row, its earliest open attempt settles it;
    every other open attempt finds it paid.
    """
    rest = ["change", "payment_id", "attempt_no", "acquirer_id", "status"]
    order = Window.partitionBy("booking_id").orderBy(F.col("first").desc(), "ts", "request_id")
    tried = (batch.where("open").withColumn("__won", F.coalesce(F.lag("first").over(order), F.lit(False)))
             .where(~F.col("first"))
             .withColumn("reject_reason", F.when(~F.col("__won"), "already_paid")).drop("__won"))
    out = batch.where(~F.col("open")).unionByName(tried).drop("open", "first")
    return out.select(*[F.when(F.col("reject_reason").isNull(), F.col(c)).alias(c) if c in rest else c for c in out.columns])


# ---------------------------------------------------------------- T1 guests

class Guests(StatefulProcessor):
    """Per lower-cased e-mail that is not stored: the visitor's key.  The e-mail's first request registers them."""

    def __init__(self, first_key: int):
        self.first_key = first_key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.visitor = handle.getValueState("visitor", "visitor_id bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.visitor.get()
        known = None if known is None else known[0]
        for r in sorted(rows, key=lambda r: r.request_id):
            new = known is None
            if new:
                known = self.first_key + r.request_id
                self.visitor.update((known,))
            yield Row(**(r.asDict() | {"visitor_id": known, "new_visitor": new}))

    def close(self) -> None:
        pass


def known_guests(r: Roles) -> DataFrame:
    """The least visitor key of every stored e-mail."""
    return (r.visitors.where(F.col("email").isNotNull()).groupBy(F.lower("email").alias("email_key"))
            .agg(F.min("visitor_id").alias("visitor_id")))


def with_visitors(requests: DataFrame, guest: Column, known: DataFrame, first_key: int) -> DataFrame:
    """A stream of requests with ``visitor_id`` and ``new_visitor``; ``guest`` rows get their e-mail's visitor.

    New keys are ``first_key`` plus the id of the registering request: unique as request
    ids are, above every stored key, and equal on replay.  They need no counter that all
    tasks share, so they have gaps.
    """
    stored = known.select(F.lit(True).alias("__g"), F.col("email_key").alias("__e"), F.col("visitor_id").alias("__v"))
    # Other rows match nothing and spread by their request, so they never share a reducer.
    rows = (requests.withColumn("__guest", F.coalesce(guest, F.lit(False)))
            .withColumn("email_key", F.when(F.col("__guest"), F.lower("email")).otherwise(F.col("request_id").cast("string")))
            .join(stored, (F.col("__guest") == F.col("__g")) & (F.col("email_key") == F.col("__e")), "left"))
    unknown = F.col("__guest") & F.col("__v").isNull()
    spare = ["__guest", "__g", "__e", "__v"]
    new = rows.where(unknown).drop(*spare)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema) + ", new_visitor boolean"
    new = new.groupBy("email_key").transformWithState(Guests(first_key), schema, "append", "none")
    return new.unionByName(rows.where(~unknown).withColumn("visitor_id", F.coalesce("__v", "visitor_id")).drop(*spare)
                           .withColumn("new_visitor", F.lit(False))).drop("email_key")
