"""Batch runners: read a request batch, run a job core, write versioned outputs.

The output of run ``version`` goes to ``<out>/<table>/v=<version>``; running
the same version again replaces it (idempotent retries).  The job cores
checkpoint their key-assignment step under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.jobs import intake
from sitelens.session import checkpoint_dir
from sitelens.sources.io import write_version
from sitelens.sources.roles import Roles
from sitelens.streaming.intake import BOOKING_REQUEST_SCHEMA, PAYMENT_ATTEMPT_SCHEMA


def _read_requests(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def run_booking_intake(spark: SparkSession, roles: Roles, requests_path: str, out: str,
                       version: str) -> dict[str, str]:
    """M1 over a folder of booking requests → bookings, payments, visitors, rejects."""
    res = intake.booking_intake(roles, _read_requests(spark, requests_path, BOOKING_REQUEST_SCHEMA))
    outputs = {"bookings": res.accepted, "payments": res.extra["payments"], "visitors": res.extra["visitors"],
               "rejects": res.rejects}
    return {k: write_version(df, f"{out.rstrip('/')}/{k}", version) for k, df in outputs.items()}


def run_payment_settlement(spark: SparkSession, roles: Roles, attempts_path: str, out: str,
                           version: str) -> dict[str, str]:
    """M2 over a folder of payment attempts → next payments and bookings tables, rejects."""
    checkpoint_dir(spark)
    res = intake.payment_settlement(roles, _read_requests(spark, attempts_path, PAYMENT_ATTEMPT_SCHEMA),
                                    cut=lambda checked: checked.checkpoint())
    outputs = {"payments": res.extra["payments"], "bookings": res.extra["bookings"], "rejects": res.rejects}
    return {k: write_version(df, f"{out.rstrip('/')}/{k}", version) for k, df in outputs.items()}
