"""SentencePiece encoding as one chain of narrow steps."""

from __future__ import annotations

import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from sitelens.llm import spm  # noqa: E402

MODEL = "piece_bpe_32k.model"


def _docs(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoin shrdlu.,é漢", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(300)]
    texts += [None, "", " ", "   x", "a▁b", texts[0], texts[0]]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_texts_and_words_are_not_shuffled(spark):
    _, docs = _docs(spark)
    rows = spm.encoded_documents(docs, P.path(MODEL))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange ") <= docs._jdf.queryExecution().executedPlan().toString().count(" Exchange ")
    assert "FlatMapCoGroupsInArrow" not in plan            # texts were dealt to blocks twice, their words twice more


def test_words_numbered_anew_give_the_same_ids(spark, monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))
    texts, docs = _docs(spark)
    want = {i: lib.encode(t or "") for i, t in enumerate(texts)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")      # words that reach over batches
    try:
        got = spm.encoded_documents(docs, P.path(MODEL)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(texts)
    # Without Spark's workers, so that the bound can be lowered.
    import pyarrow as pa
    made = []
    monkeypatch.setattr(spm, "HELD_WORDS", 50)
    rows = docs.selectExpr("doc_id k", "coalesce(text, '') t")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, task, schema: made.append(task) or self)
    cut = spm.cutter(spm.Model(P.path(MODEL)).pairs)
    spm.numbered(rows, cut)
    batches = [pa.RecordBatch.from_pydict({"k": [i], "t": [t or ""]}) for i, t in enumerate(texts)]
    held, starts = [], 0
    for b in made[0](iter(batches)):
        for r in b.to_pylist():
            if r["w"] is not None:
                starts += r["i"] == 0
                held = [] if r["i"] == 0 else held
                assert r["i"] == len(held)
                held.append(r["w"].encode())
            else:
                at = [int.from_bytes(r["parts"][j:j + 4], "little") for j in range(4, len(r["parts"]), 4)]
                assert [held[j] for j in at] == cut(texts[r["k"]] or "")
    assert starts > 3
