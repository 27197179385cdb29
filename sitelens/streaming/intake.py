"""Structured Streaming forms of the write paths.

* T1 / T2 — booking requests and payment attempts arrive as Parquet files.  What a
  request has to know of earlier ones (the visitor of a guest's e-mail, whether a
  booking is paid) is keyed state (``sitelens.streaming.state``); what the stored tables
  know is read once, into a copy beside the checkpoint that the stream joins.  No
  micro-batch reads what earlier ones wrote.  ``foreachBatch`` then writes each output under ``<sink>/<table>/batch_id=<n>`` with overwrite, so a replayed
  micro-batch (after a failure) replaces its own output instead of appending twice.
* T3 — bookings and revenue per tumbling day window, with a watermark; late
  rows past the watermark are dropped, closed windows are appended.  Spark
  judges lateness against the previous micro-batch's watermark (eviction
  uses the current one), so a row is dropped once a full batch has moved
  the watermark past it; tests cover both the batch = stream answer on
  closed windows and the dropping.
* T4 — ``dropDuplicatesWithinWatermark`` on the request id for retried
  submissions.

All sources read with an explicit schema; checkpoints live under the shared
folder named by ``spark.checkpoint.dir`` (see ``sitelens.session``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sitelens.jobs import intake
from sitelens.sources.roles import ROLE_SCHEMAS, Roles
from sitelens.streaming.state import booking_states, decided, known_guests, settle, use_keyed_state, with_visitors

BOOKING_REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("visitor_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()), T.StructField("phone", T.StringType()),
    T.StructField("site_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("no_of_tickets", T.IntegerType()), T.StructField("method", T.StringType())])

PAYMENT_ATTEMPT_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("booking_id", T.LongType()), T.StructField("method", T.StringType())])

BOOKING_FACT_SCHEMA = T.StructType([
    T.StructField("booking_id", T.LongType()), T.StructField("booking_date", T.TimestampType()),
    T.StructField("booked_ticket_price", T.DecimalType(10, 2))])


def _to_ltz(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP (session zone UTC), not TIMESTAMP_NTZ."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def dedupe_requests(df: DataFrame, key: str = "request_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """T4: drop retried submissions of the same request id within the watermark delay."""
    return _to_ltz(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def _write_batch(outputs: dict[str, DataFrame], sink: str, batch_id: int) -> None:
    """Each output goes to its own ``batch_id=<n>`` folder, replaced on replay."""
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/{name}/batch_id={batch_id}")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _previous_mark(spark: SparkSession, sink: str, batch_id: int) -> DataFrame | None:
    """The one-row key high-water mark written by the previous micro-batch, if any."""
    if batch_id == 0:
        return None
    path = f"{sink.rstrip('/')}/marks/batch_id={batch_id - 1}"
    return spark.read.parquet(path) if path_exists(spark, path) else None


def _naive(df: DataFrame, *cols: str) -> DataFrame:
    """Stored tables hold times without a zone; streams with watermarks need one."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def booking_batch_writer(roles: Roles, sink: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body of T1 over checked requests that carry their visitor.

    New booking keys continue from a one-row high-water mark written by the previous
    batch (the base table's maximum is read only by the first batch).
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = _previous_mark(spark, sink, batch_id)
        key_base = roles.bookings.select("booking_id") if mark is None else \
            mark.select(F.col("max_booking_id").alias("booking_id"))
        batch = _naive(batch, "ts").persist()
        try:
            ok = intake.assign_ids(batch.where(F.col("reject_reason").isNull()), "request_id", key_base, "booking_id",
                                   "booking_id")
            bookings, payments = intake.booking_rows(roles, ok)
            visitors = batch.where("new_visitor").select(
                "visitor_id", F.col("name").alias("full_name"), F.lit(None).cast("string").alias("nationality"),
                "email", F.col("ts").cast("date").alias("created_at"), "phone")
            rejects = batch.where(F.col("reject_reason").isNotNull()).select("request_id", "ts", "reject_reason")
            new_mark = (bookings.select("booking_id").unionByName(key_base)
                        .agg(F.max("booking_id").alias("max_booking_id")))
            _write_batch({"bookings": bookings, "payments": payments, "visitors": visitors, "rejects": rejects,
                          "marks": new_mark}, sink, batch_id)
        finally:
            batch.unpersist()
    return run


def payment_batch_writer(sink: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body of T2 over the outcomes of the attempts."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = decided(_naive(batch, "ts")).persist()
        try:
            won = batch.where(F.col("reject_reason").isNull())
            changes = won.select("payment_id", "booking_id", "change", "attempt_no", "acquirer_id", F.col("price").alias("amount"),
                                 "method", "status", F.col("ts").alias("paid_at"))
            _write_batch({"settled": won.select("booking_id", "ts", "method"), "payment_changes": changes,
                          "rejects": batch.where(F.col("reject_reason").isNotNull())
                          .select("request_id", "ts", "reject_reason")}, sink, batch_id)
        finally:
            batch.unpersist()
    return run


def _source(spark: SparkSession, source: str, schema: T.StructType, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source)


def _start(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str,
           available_now: bool) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _stored(spark: SparkSession, df: DataFrame, checkpoint: str) -> DataFrame:
    """A copy of ``df`` from the stream's first start: every micro-batch, replayed or not, joins the same rows."""
    path = f"{checkpoint.rstrip('/')}/stored"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def booking_stream(roles: Roles, requests: DataFrame, known: DataFrame, dedupe_delay: str | None = "1 hour") -> DataFrame:
    """T1 up to the sink: (T4 dedupe) → checks and prices → a guest's visitor, stored (``known``) or new."""
    if dedupe_delay:
        requests = dedupe_requests(requests, delay=dedupe_delay)
    checked = intake.checked_requests(roles, requests)
    guest = F.col("reject_reason").isNull() & F.col("visitor_id").isNull()
    first_key = roles.visitors.agg(F.coalesce(F.max("visitor_id"), F.lit(0))).first()[0] + 1
    return with_visitors(checked, guest, known, first_key)


def start_booking_stream(spark: SparkSession, roles: Roles, source: str, sink: str, checkpoint: str,
                         dedupe_delay: str | None = "1 hour", available_now: bool = True,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Booking requests → bookings, payments, new visitors, rejects per micro-batch."""
    use_keyed_state(spark)
    requests = _source(spark, source, BOOKING_REQUEST_SCHEMA, max_files_per_trigger)
    known = _stored(spark, known_guests(roles), checkpoint)
    return _start(booking_stream(roles, requests, known, dedupe_delay), booking_batch_writer(roles, sink), checkpoint, available_now)


def start_payment_stream(spark: SparkSession, roles: Roles, source: str, sink: str, checkpoint: str,
                         new_bookings: str | None = None, dedupe_delay: str | None = "1 hour",
                         available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Payment attempts → settled bookings, payment changes, rejects per micro-batch.

    ``new_bookings`` is a folder of bookings made after the start (T1's sink); an attempt
    for one settles from the micro-batch on that delivers the booking.
    """
    use_keyed_state(spark)
    attempts = _source(spark, source, PAYMENT_ATTEMPT_SCHEMA, max_files_per_trigger)
    if dedupe_delay:
        attempts = dedupe_requests(attempts, delay=dedupe_delay)
    more = spark.readStream.schema(ROLE_SCHEMAS["bookings"]).parquet(new_bookings) if new_bookings else None
    first_key = roles.payments.agg(F.coalesce(F.max("payment_id"), F.lit(0))).first()[0] + 1
    outcomes = settle(attempts, _stored(spark, booking_states(roles), checkpoint), first_key, more)
    return _start(outcomes, payment_batch_writer(sink), checkpoint, available_now)


# ---------------------------------------------------------------- T3 daily windows

def daily_totals(df: DataFrame, ts: str = "booking_date", amount: str = "booked_ticket_price") -> DataFrame:
    """Bookings and revenue per tumbling UTC day (batch and stream share this)."""
    return (df.groupBy(F.window(ts, "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("bookings"), F.sum(amount).cast("decimal(20,2)").alias("revenue"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "bookings", "revenue"))


def start_daily_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, delay: str = "1 hour",
                       available_now: bool = True) -> StreamingQuery:
    """Watermarked daily totals appended to Parquet when each day closes."""
    s = _to_ltz(spark.readStream.schema(BOOKING_FACT_SCHEMA).parquet(source), "booking_date")
    agg = daily_totals(s.withWatermark("booking_date", delay))
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def closed_windows(df: DataFrame, until: Column) -> DataFrame:
    """Rows of a daily-totals frame whose window ended at or before ``until``."""
    return df.where(F.col("window_end") <= until)
