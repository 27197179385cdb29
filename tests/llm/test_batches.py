"""Batches that Spark hands to the Python workers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from sitelens.llm.common import prepare
from sitelens.session import apply_defaults


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    apply_defaults(spark)
    docs = prepare(spark).range(6000, numPartitions=1).select(F.repeat(F.lit("some words "), 400).alias("t"))

    def task(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    rows = docs.mapInArrow(task, "n long, size long").collect()
    assert sum(r["n"] for r in rows) == 6000
    assert max(r["size"] for r in rows) < 9_000_000        # one batch of 26 MB before
