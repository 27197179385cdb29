"""Structured Streaming jobs."""

from sitelens.streaming.intake import (daily_totals, dedupe_requests, start_booking_stream, start_daily_stream,
                                       start_payment_stream)

__all__ = ["daily_totals", "dedupe_requests", "start_booking_stream", "start_daily_stream", "start_payment_stream"]
