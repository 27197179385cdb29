"""SentencePiece ids of very long unbroken words equal the library's, in time that does not grow with their square."""

from __future__ import annotations

import base64
import random
import time

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from sitelens.llm import spm  # noqa: E402

MODEL = "piece_bpe_32k.model"


def test_merged_takes_the_best_then_the_leftmost_piece():
    # aa before aaa; ties go left
    costs = {(i, i + 2): 1.0 for i in range(4)} | {(i, i + 4): 2.0 for i in range(2)}
    assert spm.merged(5, costs) == [0, 4, 5]
    assert spm.merged(1, {}) == [0, 1]
    assert spm.merged(3, {(1, 3): 1.0, (0, 2): 2.0}) == [0, 1, 3]


def test_long_words_equal_the_library(spark):
    rng = random.Random(2)
    code = base64.b64encode(rng.randbytes(15_000)).decode()
    texts = [c * n for c in ("a", "-", "=", "ab", "é", "漢") for n in (100, 5_000)]
    texts += ["a" * 20_000, "=" * 20_000, code, "x " + code[:3_000] + " y", "\U0001F600" * 70, "the" * 7_000]
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.ids, r.round_trip) for r in spm.encoded_documents(docs, P.path(MODEL)).collect()}
    assert time.time() - start < 120
    for i, t in enumerate(texts):
        assert got[i] == (lib.encode(t), True), t[:20]
