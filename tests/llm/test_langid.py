"""Language identification against a plain naive Bayes, on held-out texts, and edge cases."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest

from sitelens.llm import langid

SCHEMA = "doc_id long, text string, lang string, mass double, row string"
EN = "the river and the old bridge were there when they came with their horses through the water"
DE = "der alte Fluss und die Brücke waren schon da als sie mit ihren Pferden durch das Wasser kamen"
ES = "el río y el puente viejo ya estaban allí cuando llegaron con sus caballos por el agua"


def _rows():
    rows = []
    for i in range(60):
        lang, text = (("en", EN), ("de", DE), ("es", ES))[i % 3]
        w = text.split()
        rows.append((i, " ".join(w[(i * 5 + j * 3) % len(w)] for j in range(9)), lang, 1.0, "x"))
    return rows + [(100, None, "en", 1.0, "x"), (101, "", "de", 1.0, "x"), (102, "12 -- 3.5 !", None, 1.0, None),
                   (103, "ÇA ÉTÉ नमस्ते", None, 1.0, "x"), (104, "the water " * 4000, None, 1.0, "x"),
                   (None, "mit ihren Pferden", None, 1.0, "x"), (None, "der alte Fluss", "de", 1.0, "x"),
                   (0, rows[0][1], "en", 1.0, "x"), (105, "x" * 300_000, None, 1.0, "x")]


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def _grams(text):
    """Buckets of all n-grams, one by one."""
    fold, _ = langid.letter_tables()
    s = [0]
    for c in text or "":
        f = int(fold[ord(c)])
        if f or s[-1]:
            s.append(f)
        elif len(s) == 1:
            s.append(0)
    s.append(0)
    out = collections.Counter()
    for n in langid.GRAMS:
        for i in range(len(s) - n + 1):
            key = sum(c << 21 * j for j, c in enumerate(s[i:i + n]))
            if key:
                out[int(langid._hashed(np.array([key], np.uint64), n)[0])] += 1
    return out


def _brute(rows):
    train = [r for r in rows if r[2] is not None and r[1] is not None and not _held(r[0])]
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang, *_ in train:
        counts[lang] += _grams(t)
        texts[lang] += any(c.isalpha() for c in t)
    total = {s: sum(c.values()) for s, c in counts.items()}
    out = []
    for i, t, *_ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out.append((i, _held(i), "und", 0.0))
            continue
        g = _grams(t)
        logs = {s: math.log(max(texts[s], .5) / sum(texts.values())) + sum(
            n * math.log((counts[s][b] + langid.SMOOTH) / (total[s] + langid.SMOOTH * langid.BUCKETS)) for b, n in g.items())
            for s in sorted(counts)}
        best = max(logs, key=lambda s: logs[s])
        out.append((i, _held(i), best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


@pytest.mark.parametrize("matrix_bytes", [langid.MATRIX_BYTES, 1])
def test_equals_plain_naive_bayes(spark, monkeypatch, matrix_bytes):
    monkeypatch.setattr(langid, "MATRIX_BYTES", matrix_bytes)          # 1: every language in a pass of its own
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = _sorted([tuple(r) for r in langid.identify(df).collect()])
    want = _sorted(_brute(rows))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-3 and 0 <= a[3] <= 1 for a, b in zip(got, want))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in langid.identify(docs).collect() if r.held_out]
    assert len(got) > 40
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)


def test_language_of_a_held_out_row_is_no_input(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    other = docs.selectExpr("doc_id", "text", f"if({langid.HELD_OUT}, 'de', lang) as lang", "mass", "row")
    assert sorted(map(str, langid.identify(docs).collect())) == sorted(map(str, langid.identify(other).collect()))


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some text", None, 0.0, None), (2, None, None, 0.0, None)], SCHEMA)
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(df).collect()) == [
        (1, "und", 0.0), (2, "und", 0.0)]
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_do_not_cut_ngrams(monkeypatch):
    text = EN * 3
    whole = collections.Counter(b for _, x in langid.pieces([text, DE])[0] for b in x.tolist())
    monkeypatch.setattr(langid, "PIECE", 7)
    assert whole == collections.Counter(b for _, x in langid.pieces([text, DE])[0] for b in x.tolist())
    assert whole == _grams(text) + _grams(DE)
