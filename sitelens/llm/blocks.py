"""Word lookups for whole texts, block by block.

A dictionary of all words of a corpus can't be broadcast, and one row per word
occurrence would multiply the corpus.  Here texts are dealt once into blocks of
bounded size; a block asks for its distinct words only; requests meet the
dictionary in an equi-join on the word; and each block's texts are worked through
next to its part of the dictionary.  Both the texts and the answers of one block
fit a task whatever the corpus size (a longer single text makes a longer block).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, text_or_empty

BLOCK_CHARS = 8_000_000
HELD_WORDS = 400_000
Cut = Callable[[str], Iterable[bytes]]


def in_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (block, k, t), dealt and sorted by block; null texts are empty."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    parts = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(F.pmod(F.xxhash64("k", "t"), F.lit(n)).alias("block"), "k", "t")
    return rows.repartition(parts, "block").sortWithinPartitions("block")


def word_counts(docs: DataFrame, cut: Cut, text: str = "text") -> DataFrame:
    """Rows (word, c): occurrences of every word of all texts; counted within tasks first."""
    prepare(docs.sparkSession)

    def task(batches):
        held: Counter = Counter()

        def rows():
            words = list(held)
            for i in range(0, len(words), 20_000):
                some = words[i:i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.binary()), pa.array([held[w] for w in some], pa.int64())], ["word", "c"])
            held.clear()

        for batch in batches:
            for t in batch.column(0):
                held.update(cut(t.as_py()))
                if len(held) > HELD_WORDS:
                    yield from rows()
        yield from rows()

    counted = docs.select(text_or_empty(text).alias("t")).mapInArrow(task, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def block_requests(blocked: DataFrame, cut: Cut) -> DataFrame:
    """Rows (block, word): the distinct words of each block."""
    def task(batches):
        block, held = None, set()

        def rows():
            words = list(held)
            for i in range(0, len(words), 20_000):
                some = words[i:i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some), pa.int64()), pa.array(some, pa.binary())], ["block", "word"])
            held.clear()

        for batch in batches:
            for b, t in zip(batch.column("block").to_pylist(), batch.column("t")):
                if b != block:
                    yield from rows()
                    block = b
                held.update(cut(t.as_py()))
        yield from rows()

    # All columns go in, so that this plan's exchange of the texts is the one that their cogroup reads too.
    return blocked.mapInArrow(task, "block long, word binary")


def map_blocks(blocked: DataFrame, dictionary: DataFrame, cut: Cut, work, schema: str) -> DataFrame:
    """``work(texts, answers)`` per block: Arrow tables (block, k, t) and (block, word, values...)."""
    answers = block_requests(blocked, cut).join(dictionary, "word")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)
