"""Connected components of an edge table, without ever collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import prepare


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``edges`` (a, b): label is the least node it can reach.

    Alternates large-star and small-star steps (every node hands its neighbours its
    least neighbour) until nothing changes; the number of rounds grows with the
    logarithm of the longest path.  Loops and repeated edges are harmless.
    """
    prepare(edges.sparkSession)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = now.checkpoint(), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = down.union(small.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    # Stars are left: every node points at its least one.
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
