"""The streaming forms give the batch answers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

import pytest

from sitelens.jobs import intake
from sitelens.sources import requests as rq
from sitelens.streaming.intake import (BOOKING_FACT_SCHEMA, BOOKING_REQUEST_SCHEMA, PAYMENT_ATTEMPT_SCHEMA,
                                       closed_windows, daily_totals, dedupe_requests, start_booking_stream,
                                       start_daily_stream, start_payment_stream)


def _split_write(df, folder, col, bounds):
    """Write ``df`` into ``folder`` as one file per [lo, hi) range of ``col``, in arrival order."""
    import glob
    import shutil
    import time
    os.makedirs(folder, exist_ok=True)
    for i, (lo, hi) in enumerate(bounds):
        tmp = f"{folder}_tmp{i}"
        df.where((F.col(col) >= lo) & (F.col(col) < hi)).coalesce(1).write.parquet(tmp)
        (f,) = glob.glob(f"{tmp}/*.parquet")
        shutil.copy(f, f"{folder}/part{i}.parquet")
        time.sleep(1.1)   # distinct modification times → arrival order


def _ranges(df, parts):
    step = df.agg(F.max("request_id")).collect()[0][0] // parts + 1
    return [(i * step, (i + 1) * step) for i in range(parts)]


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


BOOKED = ["booking_id", "site_id", "event_id", "booking_date", "no_of_tickets", "booked_ticket_price"]


@pytest.fixture(scope="module")
def booked(spark, roles):
    """M1 over the booking requests, and the requests."""
    req = rq.booking_requests(spark, roles.extra["sf_dir"])
    return intake.booking_intake(roles, req), req


def _guests(bookings, visitors, base):
    """(booking, e-mail of its visitor) pairs: equal however the new visitors are numbered."""
    who = base.select("visitor_id", "email").unionByName(visitors.select("visitor_id", "email"))
    return _rows(bookings.join(who.withColumn("email", F.lower("email")), "visitor_id"), "booking_id", "email")


def test_t1_stream_equals_batch(spark, roles, booked, scratch):
    batch, req = booked
    src, sink = os.path.join(scratch, "req"), os.path.join(scratch, "sink")
    _split_write(req.withColumn("ts", F.col("ts").cast("timestamp")), src, "request_id", _ranges(req, 3))
    # One file per micro-batch, taken in arrival order.
    q = start_booking_stream(spark, roles, src, sink, os.path.join(scratch, "ckpt"), dedupe_delay=None,
                             max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(sink, "bookings"))
    assert streamed.select("batch_id").distinct().count() == 3
    assert _rows(streamed, *BOOKED) == _rows(batch.accepted, *BOOKED)
    assert _rows(spark.read.parquet(f"{sink}/payments"), "booking_id", "amount", "method") == \
        _rows(batch.extra["payments"], "booking_id", "amount", "method")
    assert _rows(spark.read.parquet(f"{sink}/rejects"), "request_id", "reject_reason") == \
        _rows(batch.rejects, "request_id", "reject_reason")
    visitors = spark.read.parquet(f"{sink}/visitors")
    names = ["full_name", "nationality", "email", "created_at"]
    assert _rows(visitors.fillna("-"), *names) == _rows(batch.extra["visitors"].fillna("-"), *names)
    assert visitors.count() == visitors.select("visitor_id").distinct().count()
    assert visitors.join(roles.visitors, "visitor_id").count() == 0
    assert _guests(streamed, visitors, roles.visitors) == _guests(batch.accepted, batch.extra["visitors"], roles.visitors)


def _forget_last_commit(checkpoint):
    """As after a crash between a micro-batch's output and its commit."""
    last = max((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    os.replace(f"{checkpoint}/commits/{last}", f"{checkpoint}/forgotten-{last}")
    crc = f"{checkpoint}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.replace(crc, f"{checkpoint}/forgotten-{last}.crc")
    return int(last)


def _spoil(folder):
    """Files that no reader can open: a later micro-batch must not read them."""
    for top, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                os.remove(os.path.join(top, "." + n + ".crc")) if os.path.exists(os.path.join(top, "." + n + ".crc")) else None
                with open(os.path.join(top, n), "wb") as f:
                    f.write(b"spoiled")


def test_t1_later_batches_read_no_earlier_output_and_replay_alike(spark, roles, booked, scratch):
    batch, req = booked
    src, sink, ck = (os.path.join(scratch, x) for x in ("req", "sink", "ckpt"))
    rows = req.withColumn("ts", F.col("ts").cast("timestamp"))
    (_, mid), _ = _ranges(req, 2)

    def run():
        start_booking_stream(spark, roles, src, sink, ck, dedupe_delay=None).awaitTermination(300)
    rows.where(F.col("request_id") < mid).write.mode("append").parquet(src)
    run()
    early = _rows(spark.read.parquet(f"{sink}/visitors"), "email")
    for name in ("bookings", "payments", "visitors", "rejects"):
        _spoil(f"{sink}/{name}")
    rows.where(F.col("request_id") >= mid).write.mode("append").parquet(src)
    run()
    outputs = {n: sorted(map(str, spark.read.parquet(f"{sink}/{n}/batch_id=1").collect()))
               for n in ("bookings", "payments", "visitors", "rejects", "marks")}
    assert sorted(early + _rows(spark.read.parquet(f"{sink}/visitors/batch_id=1"), "email")) == \
        _rows(batch.extra["visitors"], "email")
    assert _forget_last_commit(ck) == 1
    run()
    assert outputs == {n: sorted(map(str, spark.read.parquet(f"{sink}/{n}/batch_id=1").collect())) for n in outputs}


def test_t3_closed_windows_equal_batch(spark, roles, scratch):
    facts = roles.bookings.select("booking_id", F.col("booking_date").cast("timestamp").alias("booking_date"),
                                  "booked_ticket_price")
    src, sink = os.path.join(scratch, "facts"), os.path.join(scratch, "daily")
    facts.write.mode("overwrite").parquet(src)
    q = start_daily_stream(spark, src, sink, os.path.join(scratch, "ck"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink)
    last_end = streamed.agg(F.max("window_end")).collect()[0][0]
    batch = closed_windows(daily_totals(facts), F.lit(last_end))
    rows = lambda df: sorted(tuple(r) for r in df.select("window_start", "bookings", "revenue").collect())
    assert streamed.count() > 0
    assert rows(streamed) == rows(batch)


def test_t4_dedupe_within_watermark(spark, scratch):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:05:00"), (2, "2024-01-01 10:06:00")],
                               "request_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = os.path.join(scratch, "dups")
    df.write.parquet(src)
    s = spark.readStream.schema(df.schema).parquet(src)
    out = os.path.join(scratch, "dd")
    q = (dedupe_requests(s).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch, "ck4")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sorted(r["request_id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_t2_stream_settles_like_batch(spark, roles, scratch):
    att = rq.payment_attempts(spark, roles.extra["sf_dir"])
    batch = intake.payment_settlement(roles, att)
    src, sink, ck = (os.path.join(scratch, x) for x in ("att", "sink", "ckpt"))
    rows = att.withColumn("ts", F.col("ts").cast("timestamp"))
    (_, mid), _ = _ranges(att, 2)

    def run():
        start_payment_stream(spark, roles, src, sink, ck, dedupe_delay=None).awaitTermination(300)
    rows.where(F.col("request_id") < mid).write.mode("append").parquet(src)
    run()
    settled = _rows(spark.read.parquet(f"{sink}/settled"), "booking_id", "ts", "method")
    rejects = _rows(spark.read.parquet(f"{sink}/rejects"), "request_id", "reject_reason")
    changes = _rows(spark.read.parquet(f"{sink}/payment_changes"), "booking_id", "amount", "method", "status", "paid_at")
    for name in ("settled", "rejects", "payment_changes"):
        _spoil(f"{sink}/{name}")
    rows.where(F.col("request_id") >= mid).write.mode("append").parquet(src)
    run()

    def second():
        last = {n: spark.read.parquet(f"{sink}/{n}/batch_id=1") for n in ("settled", "rejects", "payment_changes")}
        return (_rows(last["settled"], "booking_id", "ts", "method"), _rows(last["rejects"], "request_id", "reject_reason"),
                _rows(last["payment_changes"], "booking_id", "amount", "method", "status", "paid_at"))
    got = second()
    assert sorted(settled + got[0]) == _rows(batch.accepted, "booking_id", "ts", "method")
    assert sorted(rejects + got[1]) == _rows(batch.rejects, "request_id", "reject_reason")
    assert sorted(changes + got[2]) == _rows(batch.extra["payment_changes"], "booking_id", "amount", "method", "status", "paid_at")
    _forget_last_commit(ck)
    run()
    assert second() == got


def test_t2_settles_bookings_made_after_the_start_and_refuses_the_rest(spark, roles, scratch):
    from decimal import Decimal
    import datetime as dt
    src, made, sink, ck = (os.path.join(scratch, x) for x in ("att", "made", "sink", "ckpt"))
    t = dt.datetime(2003, 1, 1)
    new = [(10 ** 9 + i, 1, 1, None, t, 1, Decimal(p), "pending") for i, p in enumerate(("10.00", "0.00", "5.00"))]
    spark.createDataFrame(new, roles.bookings.schema).write.parquet(made)
    tries = [(1, t, 10 ** 9, " CARD "), (2, t, 10 ** 9, "card"), (3, t, 10 ** 9 + 1, "card"), (4, t, 10 ** 9 + 2, "paypal"),
             (5, t, 10 ** 9 + 2, None), (6, t, 10 ** 9 + 7, "card"), (7, t, None, "card")]
    spark.createDataFrame(tries, PAYMENT_ATTEMPT_SCHEMA).write.parquet(src)
    start_payment_stream(spark, roles, src, sink, ck, new_bookings=made, dedupe_delay=None).awaitTermination(300)
    assert _rows(spark.read.parquet(f"{sink}/payment_changes"), "booking_id", "change", "amount", "method", "status") == [
        (10 ** 9, "insert", Decimal("10.00"), "card", "initiated")]
    assert _rows(spark.read.parquet(f"{sink}/rejects"), "request_id", "reject_reason") == [
        (2, "already_paid"), (3, "invalid_amount"), (4, "invalid_method"), (5, "invalid_method"),
        (6, "booking_not_found"), (7, "booking_not_found")]


def test_t2_stored_bookings_need_no_python_state(spark, roles, scratch):
    from sitelens.streaming.state import booking_states, settle
    src = os.path.join(scratch, "att")
    os.makedirs(src)
    plan = settle(spark.readStream.schema(PAYMENT_ATTEMPT_SCHEMA).parquet(src), booking_states(roles), 1)
    assert "TransformWithState" not in plan._jdf.queryExecution().analyzed().toString()


def test_t1_state_holds_no_stored_visitor(spark, roles, scratch):
    from sitelens.streaming.state import known_guests, use_keyed_state, with_visitors
    use_keyed_state(spark)
    src = os.path.join(scratch, "req")
    os.makedirs(src)
    req = spark.readStream.schema(BOOKING_REQUEST_SCHEMA).parquet(src)
    plan = with_visitors(req, F.col("visitor_id").isNull(), known_guests(roles), 1)._jdf.queryExecution().analyzed().toString()
    (state,) = [line for line in plan.splitlines() if "TransformWithState" in line]
    assert ", true, " not in state                                       # no initial state
    stored = roles.visitors.agg(F.min("email").alias("e"), F.min("visitor_id").alias("v")).first()
    rows = [(1, None, stored["e"].upper()), (2, None, "new@example.org"), (3, None, "NEW@example.org"), (4, 9, stored["e"])]
    rows = [(i, None, v, "n", e, None, 1, None, 1, "card") for i, v, e in rows]
    spark.createDataFrame(rows, BOOKING_REQUEST_SCHEMA).write.mode("append").parquet(src)
    got = []
    q = (with_visitors(req, F.col("visitor_id").isNull(), known_guests(roles), 10 ** 6).writeStream
         .foreachBatch(lambda b, _: got.extend(_rows(b, "request_id", "visitor_id", "new_visitor")))
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    vid = {r["email"]: r["visitor_id"] for r in roles.visitors.collect()}[stored["e"]]
    assert sorted(got) == [(1, vid, False), (2, 10 ** 6 + 2, True), (3, 10 ** 6 + 2, False), (4, 9, False)]


def test_t2_one_attempt_settles_within_a_batch_and_over_batches(spark, roles, scratch):
    import datetime as dt
    src, sink, ck = (os.path.join(scratch, x) for x in ("att", "sink", "ckpt"))
    (b,) = roles.bookings.where("payment_status = 'pending' AND booked_ticket_price > 0").limit(1).collect()
    day = [dt.datetime(2003, 1, d) for d in range(1, 5)]
    for tries in ([(5, day[2], b["booking_id"], "card"), (6, day[1], b["booking_id"], "nagad"), (7, day[0], b["booking_id"], "x")],
                  [(8, day[0], b["booking_id"], "card")]):
        spark.createDataFrame(tries, PAYMENT_ATTEMPT_SCHEMA).write.mode("append").parquet(src)
        start_payment_stream(spark, roles, src, sink, ck).awaitTermination(300)
    assert _rows(spark.read.parquet(f"{sink}/settled"), "booking_id", "ts", "method") == [(b["booking_id"], day[1], "nagad")]
    rejects = _rows(spark.read.parquet(f"{sink}/rejects"), "request_id", "reject_reason")
    assert rejects[:2] == [(5, "already_paid"), (7, "invalid_method")]   # 8 is late for the watermark or finds the booking paid
    assert rejects[2:] in ([], [(8, "already_paid")])


def test_batch_runner_is_idempotent(spark, roles, scratch):
    from sitelens.jobs.runner import run_booking_intake
    req = rq.booking_requests(spark, roles.extra["sf_dir"]).withColumn("ts", F.col("ts").cast("timestamp"))
    src = os.path.join(scratch, "breq")
    req.write.parquet(src)
    out = os.path.join(scratch, "out")
    first = run_booking_intake(spark, roles, src, out, "1")
    a = sorted(tuple(r) for r in spark.read.parquet(first["bookings"]).collect())
    again = run_booking_intake(spark, roles, src, out, "1")
    b = sorted(tuple(r) for r in spark.read.parquet(again["bookings"]).collect())
    assert a == b and len(a) > 0


def test_t3_late_rows_are_dropped(spark, scratch):
    import datetime as dt
    import glob
    import shutil
    import time
    from decimal import Decimal

    def day(d, h=12):
        return dt.datetime(2024, 1, d, h)

    # Spark (≥ 3.4) judges late rows against the previous batch's watermark, so
    # the late rows arrive two micro-batches after the data that moved it.
    first = [(i, day(d), Decimal("10.00")) for i, d in enumerate([x for x in range(1, 11) for _ in range(2)])]
    second = [(50, day(11), Decimal("5.00"))]
    third = [(100, day(2), Decimal("99.00")), (101, day(2), Decimal("99.00")), (102, day(12), Decimal("5.00"))]
    src = os.path.join(scratch, "late")
    os.makedirs(src)
    for i, rows in enumerate([first, second, third]):
        tmp = os.path.join(scratch, f"late_tmp{i}")
        spark.createDataFrame(rows, BOOKING_FACT_SCHEMA).coalesce(1).write.parquet(tmp)
        (f,) = glob.glob(f"{tmp}/*.parquet")
        shutil.copy(f, os.path.join(src, f"part{i}.parquet"))
        time.sleep(1.1)
    sink = os.path.join(scratch, "late_out")
    s = spark.readStream.schema(BOOKING_FACT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    agg = daily_totals(s.withWatermark("booking_date", "1 hour"))
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", os.path.join(scratch, "late_ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["window_start"].day: (r["bookings"], str(r["revenue"])) for r in spark.read.parquet(sink).collect()}
    assert sorted(got) == list(range(1, 12))                 # day 12 is still open
    assert got[2] == (2, "20.00")                            # the late day-2 rows were dropped
    assert got[11] == (1, "5.00")


def test_t3_months_take_each_closed_day_once(spark, roles, scratch):
    from sitelens.sources.snapshots import SnapshotTable
    from sitelens.streaming.rollup import merge_days, start_month_stream
    facts = roles.bookings.select("booking_id", F.col("booking_date").cast("timestamp").alias("booking_date"),
                                  "booked_ticket_price")
    src, ck, table = os.path.join(scratch, "facts"), os.path.join(scratch, "ck"), SnapshotTable(spark, f"{scratch}/months")

    def run():
        start_month_stream(spark, src, table, ck).awaitTermination(300)

    def months():
        return _rows(table.read(), "month", "bookings", "revenue")
    facts.where("booking_date < '1998-03-10'").write.mode("append").parquet(src)
    run()
    facts.where("booking_date >= '1998-03-10'").write.mode("append").parquet(src)
    run()
    mark = facts.select((F.max("booking_date") - F.expr("INTERVAL 1 HOUR")).alias("m")).scalar()      # the watermark
    days = daily_totals(facts).where(F.col("window_end") <= mark)
    want = _rows(days.groupBy(F.trunc("window_start", "month").alias("m")).agg(
        F.sum("bookings").alias("n"), F.sum("revenue").cast("decimal(20,2)").alias("v")), "m", "n", "v")
    assert months() == want
    number = table.current().number
    _forget_last_commit(ck)
    run()
    assert months() == want and table.current().number == number                    # the replayed batch commits nothing
    merge_days(table, days.unionByName(days))                                       # a backfill of known days
    assert months() == want
