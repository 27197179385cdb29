"""Intake jobs: M1 bookings, M2 payment settlement, M7 reviews, M8 sign-ups, M9 contacts, M10 methods.

Each job takes the current role tables plus a batch of requests and returns
the rows to append / the next table versions and a reject frame with a
reason per request — one pure DataFrame core shared by batch runs and the
streaming ``foreachBatch`` sinks.  New surrogate keys are dense: the table's
current maximum plus the request's rank in the batch (``assign_ids``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.joins import salt_count
from sitelens.operators.windows import latest_per_key
from sitelens.sources.roles import DEC, Roles

# The payment-method domain accepted at intake, in declaration order.
ALLOWED_METHODS = ["bkash", "nagad", "rocket", "card", "bank_transfer"]
DEFAULT_METHOD = "bkash"
# The patterns used by the reference's validators.
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
METHOD_CODE_RE = r"^[a-z0-9_\-]{2,40}$"
# The widths to which the admin visitor form cuts; the e-mail, the unique key, is never cut.
VISITOR_WIDTHS = {"full_name": 120, "phone": 30, "nationality": 80}


@dataclass
class JobResult:
    """Outputs of an intake job (unused outputs are None)."""

    accepted: DataFrame
    rejects: DataFrame
    extra: dict


def assign_ids(df: DataFrame, order_col: str, table: DataFrame, key: str, out: str,
               partitions: int | None = None) -> DataFrame:
    """Dense new keys: max(existing key) + position of ``order_col`` (unique) in the batch.

    The batch is range-partitioned and sorted on ``order_col`` and then
    checkpointed (reliably, under ``spark.checkpoint.dir``): that fixes each
    row's partition and position, cuts the lineage of the validation steps
    before it, and survives lost executors.  A row's key is the table maximum
    + the row counts of all earlier partitions (a ≤ ``partitions``-row table)
    + its position inside its partition.  No task sees more than its range.
    """
    from sitelens.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    start = table.select(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    x = (df.repartitionByRange(n, F.col(order_col)).sortWithinPartitions(order_col)
         .withColumn("__pid", F.spark_partition_id())
         .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
         .checkpoint(eager=True))
    sizes = x.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return (x.join(F.broadcast(offsets), "__pid")
            .withColumn(out, (start + F.col("__off") + F.col("__pos") + 1).cast("bigint"))
            .drop("__pid", "__pos", "__off"))


def _reason(checks: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for cond, name in reversed(checks):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


# ---------------------------------------------------------------- M1 bookings

def checked_requests(r: Roles, requests: DataFrame) -> DataFrame:
    """Cleaned booking requests with ``reject_reason`` (NULL: accepted) and the booked price.

    Stateless, so a stream of requests can pass through it as well as a batch.
    """
    req = requests.select(
        "request_id", "ts", "visitor_id", F.trim("name").alias("name"), F.trim("email").alias("email"),
        F.trim("phone").alias("phone"), "site_id", "event_id",
        F.greatest(F.lit(1), F.coalesce(F.col("no_of_tickets"), F.lit(1))).alias("no_of_tickets"),
        F.lower(F.trim(F.coalesce(F.col("method"), F.lit(DEFAULT_METHOD)))).alias("__m"))
    req = req.withColumn("method", F.when(F.col("__m").isin(*ALLOWED_METHODS), F.col("__m"))
                         .otherwise(F.lit(DEFAULT_METHOD))).drop("__m")
    # The site is priced when given, else the event: one (kind, id) join against
    # the union of both price tables prices every request in a single shuffle.
    prices = (r.sites.select(F.lit(0).alias("__tk"), F.col("site_id").alias("__tid"), F.col("ticket_price").alias("__tp"))
              .unionByName(r.evts.select(F.lit(1).alias("__tk"), F.col("event_id").alias("__tid"),
                                         F.col("ticket_price").alias("__tp")))
              .withColumn("__nsalt", F.when(F.col("__tid").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")))
    req = (req.withColumn("__fk", F.when(F.col("site_id").isNotNull(), F.lit(0))
                          .when(F.col("event_id").isNotNull(), F.lit(1)))
           .withColumn("__fid", F.coalesce("site_id", "event_id"))
           .withColumn("__salt", F.when(F.col("__fid").isNull(), F.pmod(F.xxhash64("request_id"), F.lit(salt_count(requests))) + 1)
                       .otherwise(F.lit(0))))
    req = req.join(prices, (F.col("__fk") == F.col("__tk")) & (F.col("__fid") == F.col("__tid"))
                   & (F.col("__salt") == F.col("__nsalt")), "left") \
        .drop("__fk", "__fid", "__salt", "__tk", "__tid", "__nsalt")
    guest = F.col("visitor_id").isNull()
    reason = _reason([
        (F.col("site_id").isNull() & F.col("event_id").isNull(), "no_target"),
        (F.col("site_id").isNotNull() & F.col("__tp").isNull(), "site_not_found"),
        (F.col("site_id").isNull() & F.col("__tp").isNull(), "event_not_found"),
        (F.col("site_id").isNotNull() & F.col("event_id").isNotNull(), "both_targets"),
        (guest & (_blank(F.col("name")) | _blank(F.col("email"))), "guest_name_email_required"),
    ])
    price = F.when(reason.isNull(), F.col("__tp") * F.col("no_of_tickets")).cast(DEC)
    return req.withColumn("booked_ticket_price", price).withColumn("reject_reason", reason).drop("__tp")


def booking_intake(r: Roles, requests: DataFrame) -> JobResult:
    """M1: booking requests → new bookings, initiated payments, new guest visitors, rejects.

    Rules: tickets ≥ 1 (missing → 1); the site is used when given, else the
    event; no target → reject; unknown target → reject; both targets →
    reject (XOR); method trimmed/lower-cased, unknown → 'bkash'; price =
    target price × tickets; guests need name and email, are matched by
    email, else registered (one new visitor per new email, earliest wins).
    """
    req = checked_requests(r, requests)
    guest = F.col("visitor_id").isNull()
    # Bookings, visitors, payments and rejects all start here: validate once.
    from sitelens.session import checkpoint_dir
    checkpoint_dir(req.sparkSession)
    req = req.checkpoint(eager=True)
    ok = req.where(F.col("reject_reason").isNull())
    rejects = req.where(F.col("reject_reason").isNotNull()).select("request_id", "ts", "reject_reason")

    # Guests: existing visitor by email, else one new visitor per new email.
    # E-mails compare without case (the column is unique that way).  Only guests meet
    # the e-mail joins, so signed-in visitors' NULL e-mails never share a reducer.
    existing = (r.visitors.where(F.col("email").isNotNull()).groupBy(F.lower("email").alias("__e"))
                .agg(F.min("visitor_id").alias("__vid")))
    known = ok.where(~guest)
    g = ok.where(guest).withColumn("__k", F.lower("email"))
    g = g.join(existing, F.col("__k") == F.col("__e"), "left").drop("__e")
    new_emails = (g.where(F.col("__vid").isNull())
                  .groupBy("__k").agg(F.min(F.struct("request_id", "email", "name", "phone", "ts")).alias("__f"))
                  .select("__k", F.col("__f.email").alias("email"), F.col("__f.request_id").alias("__first"), F.col("__f.name").alias("full_name"),
                          F.col("__f.phone").alias("phone"), F.col("__f.ts").alias("__ts")))
    new_visitors = assign_ids(new_emails, "__first", r.visitors, "visitor_id", "visitor_id")
    nv = new_visitors.select(F.col("__k").alias("__ne"), F.col("visitor_id").alias("__nvid"))
    g = g.join(nv, F.col("__k") == F.col("__ne"), "left")
    g = g.withColumn("visitor_id", F.coalesce("__vid", "__nvid")).drop("__k", "__vid", "__ne", "__nvid")
    g = g.unionByName(known)

    g = assign_ids(g, "request_id", r.bookings, "booking_id", "booking_id")
    bookings, payments = booking_rows(r, g)
    visitors = new_visitors.select("visitor_id", "full_name", F.lit(None).cast("string").alias("nationality"),
                                   "email", F.col("__ts").cast("date").alias("created_at"), "phone")
    return JobResult(bookings, rejects, {"payments": payments, "visitors": visitors})


def booking_rows(r: Roles, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New bookings and their initiated payments of requests with a ``booking_id``."""
    bookings = numbered.select("booking_id", "visitor_id", "site_id", "event_id", F.col("ts").alias("booking_date"),
                               F.col("no_of_tickets").cast("bigint"), "booked_ticket_price",
                               F.lit("pending").alias("payment_status"))
    payments = numbered.select((first_new_payment(r) + F.col("request_id")).alias("payment_id"), "booking_id",
                               F.lit(1).alias("attempt_no"), F.lit(None).cast("bigint").alias("acquirer_id"),
                               F.col("booked_ticket_price").alias("amount"), "method", F.lit("initiated").alias("status"),
                               F.col("ts").alias("paid_at"))
    return bookings, payments


# ---------------------------------------------------------------- M2 payments

def checked_attempts(r: Roles, attempts: DataFrame) -> DataFrame:
    """Cleaned payment attempts with the booked price and ``reject_reason`` (NULL: accepted)."""
    a = attempts.select("request_id", "ts", "booking_id", F.lower(F.trim("method")).alias("method"))
    b = r.bookings.select(F.col("booking_id").alias("__bid"), "payment_status", "booked_ticket_price")
    a = a.join(b, F.col("booking_id") == F.col("__bid"), "left")
    valid_m = F.coalesce(F.col("method").isin(*ALLOWED_METHODS), F.lit(False))
    first_ok = (a.where(valid_m & F.col("__bid").isNotNull())
                .groupBy("booking_id").agg(F.min(F.struct("ts", "request_id")).alias("__w"))
                .select(F.col("booking_id").alias("__wb"), F.col("__w.request_id").alias("__wr")))
    a = a.join(first_ok, F.col("booking_id") == F.col("__wb"), "left")
    reason = _reason([
        (F.col("__bid").isNull(), "booking_not_found"),
        (~valid_m, "invalid_method"),
        (F.col("payment_status") == "paid", "already_paid"),
        (F.col("booked_ticket_price") <= 0, "invalid_amount"),
        (F.col("request_id") != F.col("__wr"), "already_paid"),
    ])
    return a.withColumn("reject_reason", reason)


def first_new_payment(r: Roles) -> Column:
    """What a new payment's key adds to its request's id: above every stored key (a lazy scalar)."""
    return r.payments.select((F.coalesce(F.max("payment_id"), F.lit(0)) + 1).cast("bigint")).scalar()


def payment_settlement(r: Roles, attempts: DataFrame,
                       cut: Callable[[DataFrame], DataFrame] = lambda checked: checked) -> JobResult:
    """M2: payment attempts → next payments and bookings tables plus rejects.

    Per booking the earliest attempt with a valid method settles it (later
    ones find it already paid).  Settling updates the booking's latest
    payment to 'successful' (amount = booked price, new method and time) or,
    when the booking has no payment yet, inserts one with status 'initiated'
    (the reference's behaviour; M6 reports it).  The booking becomes 'paid'.
    A new payment's key is the table's maximum + 1 + its request's id: unique, equal on
    a retry, and known without numbering.

    Building the frames starts no job.  A job that writes several of them passes ``cut``
    to keep the checked attempts once (a checkpoint or a stored table).
    """
    a = cut(checked_attempts(r, attempts))
    rejects = a.where(F.col("reject_reason").isNotNull()).select("request_id", "ts", "reject_reason")
    win = a.where(F.col("reject_reason").isNull()).select("request_id", "booking_id", "ts", "method",
                                                          F.col("booked_ticket_price").alias("__amt"))

    # Only the settled bookings' payments can change: their latest one, by its key.
    order = ["paid_at", "attempt_no", "acquirer_id", "amount", "method", "status", "payment_id"]
    settled = win.select(F.col("booking_id").alias("__wb"))
    touched = r.payments.join(settled, F.col("booking_id") == F.col("__wb"), "left_semi")
    latest = latest_per_key(touched.select("booking_id", *order), "booking_id", order)
    target = win.join(latest.select(F.col("booking_id").alias("__lb"), F.col("payment_id").alias("__pid")),
                      F.col("booking_id") == F.col("__lb"), "left").drop("__lb")
    paying = target.select(F.col("booking_id").alias("__tb"), "__pid", F.col("ts").alias("__ts"),
                           F.col("method").alias("__m"), "__amt")
    p = r.payments.join(paying, F.col("booking_id") == F.col("__tb"), "left")
    hit = F.coalesce(F.col("payment_id") == F.col("__pid"), F.lit(False))
    updated = p.select(
        "payment_id", "booking_id", "attempt_no", "acquirer_id",
        F.when(hit, F.col("__amt")).otherwise(F.col("amount")).cast(DEC).alias("amount"),
        F.when(hit, F.col("__m")).otherwise(F.col("method")).alias("method"),
        F.when(hit, F.lit("successful")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("__ts")).otherwise(F.col("paid_at")).alias("paid_at"),
        hit.alias("__changed"))
    fresh = target.where(F.col("__pid").isNull()).select(
        (first_new_payment(r) + F.col("request_id")).alias("payment_id"), "booking_id", F.lit(1).alias("attempt_no"),
        F.lit(None).cast("bigint").alias("acquirer_id"), F.col("__amt").cast(DEC).alias("amount"), "method",
        F.lit("initiated").alias("status"), F.col("ts").alias("paid_at"))
    payments = updated.drop("__changed").unionByName(fresh)
    # Only the rows this batch touched: for incremental sinks that must not
    # rewrite the whole payments table per batch.
    changes = updated.where("__changed").drop("__changed").unionByName(fresh)
    paid = win.select(F.col("booking_id").alias("__pb"), F.lit(True).alias("__paid"))
    bookings = (r.bookings.join(paid, F.col("booking_id") == F.col("__pb"), "left")
                .withColumn("payment_status", F.when(F.col("__paid"), F.lit("paid")).otherwise(F.col("payment_status")))
                .drop("__pb", "__paid"))
    return JobResult(win.drop("request_id"), rejects, {"payments": payments, "bookings": bookings, "payment_changes": changes})


# ---------------------------------------------------------------- M7 reviews

def review_intake(r: Roles, requests: DataFrame) -> JobResult:
    """M7: rating clamped to 1..5 (missing → 5), comment trimmed, one target required (XOR)."""
    q = requests.select(
        "request_id", "ts", "visitor_id", "site_id", "event_id",
        F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.col("rating"), F.lit(5)))).cast("int").alias("rating"),
        F.trim("comment").alias("comment"))
    reason = _reason([(F.col("site_id").isNull() & F.col("event_id").isNull(), "no_target"),
                      (F.col("site_id").isNotNull() & F.col("event_id").isNotNull(), "both_targets")])
    q = q.withColumn("reject_reason", reason)
    rejects = q.where(F.col("reject_reason").isNotNull()).select("request_id", "ts", "reject_reason")
    ok = assign_ids(q.where(F.col("reject_reason").isNull()), "request_id", r.reviews, "review_id", "review_id")
    reviews = ok.select("review_id", "visitor_id", "site_id", "event_id", "rating", "comment",
                        F.col("ts").cast("date").alias("review_date"))
    return JobResult(reviews, rejects, {})


# ---------------------------------------------------------------- M8 visitors

def visitor_registration(r: Roles, requests: DataFrame, admin: bool = False) -> JobResult:
    """M8: trimmed fields, lower-cased unique email (first request wins), format check.

    ``admin=True`` truncates fields to the column widths instead of failing.
    """
    cols = {c: F.trim(c) for c in ("full_name", "phone", "nationality")}
    cols["email"] = F.lower(F.trim("email"))
    q = requests.select("request_id", "ts", *[v.alias(k) for k, v in cols.items()])
    if admin:
        q = q.select("request_id", "ts", "email",
                     *[F.substring(c, 1, w).alias(c) for c, w in VISITOR_WIDTHS.items()])
    existing = r.visitors.select(F.lower("email").alias("__e")).distinct()
    q = q.join(existing, F.col("email") == F.col("__e"), "left")
    base = _reason([
        (_blank(F.col("full_name")) | _blank(F.col("email")), "required_field_missing"),
        (~F.col("email").rlike(EMAIL_RE), "invalid_email"),
        (F.col("__e").isNotNull(), "email_exists"),
    ])
    q = q.withColumn("__base", base)
    # Among the requests that would register, the earliest per email wins; the
    # others find the email taken (requests that fail validation never register).
    first = (q.where(F.col("__base").isNull()).groupBy("email")
             .agg(F.min(F.struct("ts", "request_id")).alias("__f"))
             .select(F.col("email").alias("__fe"), F.col("__f.request_id").alias("__fr")))
    q = q.join(first, F.col("email") == F.col("__fe"), "left")
    reason = F.coalesce(F.col("__base"), F.when(F.col("request_id") != F.col("__fr"), F.lit("email_exists")))
    q = q.withColumn("reject_reason", reason)
    rejects = q.where(F.col("reject_reason").isNotNull()).select("request_id", "ts", "reject_reason")
    ok = assign_ids(q.where(F.col("reject_reason").isNull()), "request_id", r.visitors, "visitor_id", "visitor_id")
    visitors = ok.select("visitor_id", "full_name", "nationality", "email", F.col("ts").cast("date").alias("created_at"),
                         "phone")
    return JobResult(visitors, rejects, {})


# ---------------------------------------------------------------- M9 contacts

def contact_intake(requests: DataFrame) -> JobResult:
    """M9: name/email/message trimmed; email and message required."""
    q = requests.select("request_id", "ts", F.trim("name").alias("name"), F.trim("email").alias("email"),
                        F.trim("message").alias("message"))
    q = q.withColumn("reject_reason", _reason([(_blank(F.col("email")) | _blank(F.col("message")),
                                                "email_and_message_required")]))
    return JobResult(q.where(F.col("reject_reason").isNull()).drop("reject_reason"),
                     q.where(F.col("reject_reason").isNotNull()).select("request_id", "ts", "reject_reason"), {})


# ---------------------------------------------------------------- M10 method domain

def method_domain_growth(domain: DataFrame, proposals: DataFrame) -> JobResult:
    """Extend the method domain with valid new codes (regex, label ≤ 150, no duplicates).

    ``domain`` has (code, label, position); new codes get the next positions
    in code order (dense, via ``assign_ids``).
    """
    p = proposals.select(F.lower(F.trim("code")).alias("code"), F.trim("label").alias("label"))
    p = p.withColumn("reject_reason", _reason([
        (~F.col("code").rlike(METHOD_CODE_RE), "invalid_code"),
        (_blank(F.col("label")) | (F.length("label") > 150), "invalid_label")]))
    rejects = p.where(F.col("reject_reason").isNotNull())
    ok = (p.where(F.col("reject_reason").isNull()).groupBy("code").agg(F.min("label").alias("label"))
          .join(domain.select("code"), "code", "left_anti"))
    new = assign_ids(ok, "code", domain, "position", "position").select(
        "code", "label", F.col("position").cast("int").alias("position"))
    return JobResult(domain.select("code", "label", "position").unionByName(new), rejects, {"added": new})


def method_domain(spark) -> DataFrame:
    """The declared method domain as a (code, label, position) table (labels: '_' → ' ', ucfirst)."""
    from sitelens.functions.text import display_label
    d = spark.createDataFrame([(m, i + 1) for i, m in enumerate(ALLOWED_METHODS)], "code string, position int")
    return d.select("code", display_label("code").alias("label"), "position")
