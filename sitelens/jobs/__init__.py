"""Write paths re-aimed as bulk table jobs.

Every job is a pure DataFrame → DataFrame core (used by the batch runner and
by the streaming ``foreachBatch`` sinks alike); writing is separate
(``sitelens.sources.io``), so a job is idempotent per input batch.
"""
