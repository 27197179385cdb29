"""Replay of a request table through a stream, as a query returns it.

The requests are handed over in parts.  Each part is written to the stream's source
folder and worked off by a run of its own (``availableNow``), so every part is a
micro-batch and every run but the first restarts from the checkpoint and its state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sitelens.session import checkpoint_dir


def replay(requests: DataFrame, schema: T.StructType, parts: list[Column],
           start: Callable[[str, str, str], StreamingQuery]) -> str:
    """Run ``start(source, sink, checkpoint)`` once per part of ``requests``; returns the sink folder."""
    base = f"{checkpoint_dir(requests.sparkSession)}/replay-{uuid.uuid4().hex}"
    source, sink, checkpoint = (f"{base}/{x}" for x in ("source", "sink", "checkpoint"))
    rows = requests.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    for part in parts:
        rows.where(part).write.mode("append").parquet(source)
        query = start(source, sink, checkpoint)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return sink
