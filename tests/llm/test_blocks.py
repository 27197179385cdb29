"""Texts and words that meet block by block."""

from __future__ import annotations

import pyarrow as pa

from sitelens.llm import blocks, hmm


def test_texts_are_dealt_to_their_blocks_once(spark):
    rows = [(i, f"some words {i} and more {i % 7}") for i in range(200)] + [(None, None), (5, "x"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = blocks.word_counts(docs, hmm.cut)

    def work(texts, found):
        return pa.table({"k": texts.column("k"), "n": pa.array([found.num_rows] * texts.num_rows, pa.int64())})

    blocked = blocks.in_blocks(docs, block_chars=1000)
    out = blocks.map_blocks(blocked, counts, hmm.cut, work, "k long, n long")
    assert len(out.collect()) == len(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final           # the requests read the exchange of the texts that the cogroup reads
