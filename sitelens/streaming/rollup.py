"""T3 roll-up: closed days merged once into stored month totals.

The month table (one row a month, behind a snapshot pointer) remembers in a bit mask
which of its days it holds.  A merge adds only days that a month lacks, so a day that
arrives again - a replayed micro-batch, a backfill that overlaps - changes nothing, and
its work follows the new days and the months, not the facts behind them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelens.sources.snapshots import Snapshot, SnapshotTable
from sitelens.streaming.intake import BOOKING_FACT_SCHEMA, daily_totals

MONTHS = "month date, days int, bookings bigint, revenue decimal(20,2)"


def merge_days(table: SnapshotTable, days: DataFrame, txn: str | None = None) -> Snapshot:
    """Add daily totals (``window_start``, ``bookings``, ``revenue``) to the months that lack the day."""
    if table.current() is None:
        table.commit(table.spark.createDataFrame([], MONTHS), None, "empty")
    start = F.col("window_start").cast("date")
    one = days.select(start.alias("day"), F.struct(F.col("bookings").cast("bigint").alias("bookings"), "revenue").alias("v"))
    one = one.groupBy("day").agg(F.max("v").alias("v"))                   # a day that the input repeats counts once
    one = one.select(F.trunc("day", "month").alias("month"), F.expr("shiftleft(1, dayofmonth(day) - 1)").alias("days"),
                     "v.bookings", "v.revenue")

    def change(months: DataFrame) -> DataFrame:
        held = months.select(F.col("month").alias("__m"), F.col("days").alias("__held"))
        fresh = one.join(held, F.col("month") == F.col("__m"), "left")
        fresh = fresh.where(F.coalesce("__held", F.lit(0)).bitwiseAND(F.col("days")) == 0).select(*months.columns)
        return months.unionByName(fresh).groupBy("month").agg(
            F.bit_or("days").alias("days"), F.sum("bookings").alias("bookings"),
            F.sum("revenue").cast("decimal(20,2)").alias("revenue"))
    return table.update(change, txn)


def month_writer(table: SnapshotTable, name: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: the days that a micro-batch closes; a replayed batch commits nothing anew."""
    def run(batch: DataFrame, batch_id: int) -> None:
        days = batch.persist()
        try:
            days.count()          # the stream's state must advance even if the months hold these days already
            merge_days(table, days, f"{name}-{batch_id}")
        finally:
            days.unpersist()
    return run


def start_month_stream(spark: SparkSession, source: str, table: SnapshotTable, checkpoint: str, delay: str = "1 hour",
                       available_now: bool = True) -> StreamingQuery:
    """Watermarked daily totals, merged into the month table when a day closes."""
    facts = spark.readStream.schema(BOOKING_FACT_SCHEMA).parquet(source)
    days = daily_totals(facts.withWatermark("booking_date", delay))
    w = (days.writeStream.outputMode("append").foreachBatch(month_writer(table, checkpoint))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
