"""Periodic runs against brute force: the numpy core on periodic words, the query's contract row by row."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sitelens.llm import runs
from sitelens.llm.queries import op12_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(w, least=12):
    """(start, end, period) by comparing all words q apart, for every q."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def _periodic(rng):
    kind, n = rng.randrange(5), rng.randint(0, 80)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:                                        # runs that touch: their middle ends many runs
        return list("ab" * rng.randint(0, 20) + "ba" * rng.randint(0, 20) + "ab" * 9)
    if kind == 2:                                        # Fibonacci words are rich in runs
        a, b = "a", "ab"
        for _ in range(rng.randint(1, 9)):
            a, b = b, b + a
        return list(b[:130])
    out = []
    while len(out) < n:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        out += (unit * rng.randint(1, 9))[:rng.randint(1, 60)]
    return out


@pytest.mark.parametrize("least", [2, 3, 6, 9, 12, 21, 30])
def test_all_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        docs = [[x.encode() for x in _periodic(rng)] for _ in range(rng.randint(1, 4))]
        got = runs.runs_of(docs, least)
        assert [[tuple(map(int, r)) for r in g] for g in got] == [_brute(d, least) for d in docs]


def test_wavelet_tree_successor():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 300, 400)
    tree = runs.WaveletTree(values)
    lo = rng.integers(0, 400, 500)
    hi = np.minimum(400, lo + rng.integers(0, 60, 500))
    v = rng.integers(0, 700, 500)
    want = [min((x for x in values[a:b] if x >= y), default=-1) for a, b, y in zip(lo, hi, v)]
    assert tree.successor(lo, hi, v).tolist() == want


def _contract(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = [(s, e - s, q) for s, e, q in _brute(w)]
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_query_equals_contract(spark, scratch):
    rng = random.Random(5)
    texts = ["one two " * 40, "a b c\x0bd\x0ce\x85f g " * 12, "", None, " \n\t", "x", "é ü " * 30 + "Ω"]
    texts += [" ".join(_periodic(rng)) for _ in range(60)]
    planted = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    ids = [*planted[:33], *range(2000, 2034)]
    rows = [(i, t, "en", 1, "x") for i, t in zip(ids, texts)]
    rows += [(None, "a b " * 20, None, 0, None), (None, None, None, 0, None), rows[0], (planted[40], None, "en", 1, "x"),
             (planted[41], "", "en", 1, "x")]
    schema = "doc_id long, text string, lang string, n_words long, runs string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{scratch}/documents.parquet")
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = op12_periodic_runs(spark, scratch)
    assert got.columns == cols
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *_contract(i, t)) for i, t, *_ in rows), key=key)


def test_operator_gives_spans_and_texts_and_takes_empty_tables(spark):
    df = spark.createDataFrame([("k", "x a b a b a b a b a b a b a b y")], "name string, body string")
    (row,) = runs.periodic_runs(df, key="name", text="body").collect()
    assert row.asDict(True) == {"name": "k", "n_words": 16, "runs": [{"start": 1, "length": 14, "period": 2}],
                                "collapsed": "x a b y"}
    assert runs.periodic_runs(df.filter("false"), key="name", text="body").collect() == []


def test_long_texts():
    for w in ([b"a"] * 60_000, [b"a", b"b"] * 15_000 + [b"b", b"a"] * 15_000, [b"%d" % (i % 5_000) for i in range(50_000)]):
        found = runs.runs_of([w])[0]
        s, e, q = found[np.argmax(found[:, 1] - found[:, 0])]
        assert all(w[i] == w[i + q] for i in range(s, e - q))
    assert len(runs.runs_of([[b"a", b"b"] * 15_000 + [b"b", b"a"] * 15_000])[0]) > 10_000     # about the middle
