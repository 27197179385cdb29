"""Source divergence against plain counting, with and without shards beyond the broadcast."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sitelens.llm import divergence

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, shard int, n string"


def _rows():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("Äh", "the", "Zü", "ox", "naïve", "漢字", "e") for b in ("", "A", "b", "q", "É", "ß")]
    rows = []
    for i in range(180):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "", None, "s3"])
        some = rng.sample(vocabulary, 14) if source == "s1" else vocabulary
        rows.append((i, rng.choice([" ", "-", "1", "_"]).join(rng.choices(some, k=rng.randint(0, 40))), lang, source, 1, "x"))
    rows += [(None, None, "en", "only nulls", 1, None), (1, "", "xx", "s1", 1, "x"), (1, "rare words", "xx", "s2", 1, "x"),
             (7, "12 34", "yy", "alone", 1, "x"), rows[0], rows[0]]
    return rows


def _brute(rows, least=10, top=10):
    groups, df = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, source, *_ in rows:
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        groups[lang or "", source or ""].update(terms)
        df.update((lang or "", t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (s, t), n in df.items() if s == lang and n >= least)
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def share(c):
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        def gap(a, b):
            return (a - b) ** 2 // (a + b)

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, r) for r, x in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("head_bytes", [divergence.HEAD_BYTES, 700, 0])
def test_equals_plain_counting(spark, head_bytes):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.audit(df, head_bytes=head_bytes)
    assert set(got.columns) == {"lang", "source", "part", "item", "value", "rank"}
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == _brute(rows)


def test_empty_table_and_no_terms(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, None, "en", "a", 1, "x"), (2, "few words", "en", "b", 1, "x")], SCHEMA)
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in divergence.audit(df).collect()) == [
        ("a", "b", 0, 1), ("b", "a", 0, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5000])
def test_perfect_hash_is_minimal_and_verified(n):
    terms = [b"t%d" % i for i in range(n)]
    order, sizes, bits = divergence.build(divergence.hashes_of(terms))
    table = divergence.PerfectHash([(sizes, bits, pa.array([terms[i] for i in order], pa.binary()))])
    slots = table.find(terms, divergence.hashes_of(terms))
    assert sorted(slots.tolist()) == list(range(n))
    assert [table.terms[i].as_py() for i in slots] == terms
    other = [b"u%d" % i for i in range(2000)]
    assert (table.find(other, divergence.hashes_of(other)) == -1).all()


def test_keys_of_one_hash_are_told_apart_by_their_terms():
    terms = [b"one", b"two", b"three"]
    same = np.full(3, 12345, np.uint64)
    order, sizes, bits = divergence.build(same)
    table = divergence.PerfectHash([(sizes, bits, pa.array([terms[i] for i in order], pa.binary()))])
    assert sorted(table.find(terms, same).tolist()) == [0, 1, 2]
    assert table.find([b"four"], same[:1]).tolist() == [-1]


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 5, 10 ** 13, 3 * 10 ** 14], np.int64)
    total, kept = 7 * 10 ** 14, 1000
    assert divergence.shares(counts, total, kept).tolist() == [
        1 + 10 ** 9 * (int(c) + 2) // (total + 2 * kept) for c in counts]
