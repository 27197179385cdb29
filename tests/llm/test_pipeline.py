"""The corpus pipeline: all stages by run(), each against an independent version, with awkward rows among them."""

from __future__ import annotations

import collections
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sitelens.llm import mixing, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string"


def _rows():
    rng = random.Random(4)
    out = []
    for g in range(30):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.randint(0, 60)}" for _ in range(120)]
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2"])
        for v in range(rng.choice([1, 1, 2, 4])):
            x = list(w)
            if v:
                x[rng.randrange(120)] = f"changed{v}"
            out.append((10 * g + v, " ".join(x), lang, source, 1, "x"))
    out += [(None, None, None, None, None, None), (None, "", "en", "s1", 0, ""), (7, " \n", "en", "s1", 0, "y"),
            (None, out[0][1] + " without an id", "en", "s1", 1, None), (3, "too short", "en", "s1", 1, "x"),
            (10, " ".join(f"other{i}" for i in range(90)), "en", "s1", 1, "same id, other text"), out[5], out[5],
            (400, "word " * 300, "en", "s1", 1, "x")]
    return out


def _shingles(t, size=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _near_kept(rows):
    """Of each group at 5 words and 80 %, the row with the smallest doc_id (none last); equal rows are one."""
    rows = sorted(set(rows), key=str)
    sets, top = [_shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return {min((r[0] is None, r[0]) for r in g) for g in groups.values()}, len(groups)


def _tuples(df):
    return [tuple(r) for r in df.collect()]


def test_run_does_every_stage(spark, scratch):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{scratch}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = _tuples(stages["quality_rules"](spark, docs, scratch))
    # Rows are told apart by all columns, so the verdict on (id, text, ...) is asked with the row's place as its key.
    placed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place long, " + SCHEMA)
    good = {r.place for r in quality.quality(placed, key="place").filter("kept").collect()}
    assert sorted(kept, key=str) == sorted((r for i, r in enumerate(rows) if i in good), key=str)
    assert (3, "too short", "en", "s1", 1, "x") not in kept and len(kept) > 40

    second = spark.createDataFrame(kept, SCHEMA)
    single = _tuples(stages["jaccard_join"](spark, second, scratch))
    ids, n = _near_kept(kept)
    assert len(single) == n and {(r[0] is None, r[0]) for r in single} == ids and set(single) <= set(kept)
    assert sum(r[0] == 10 for r in single) == sum(r[0] == 10 for r in set(kept))         # one id, two texts: both stay

    third = spark.createDataFrame(single, SCHEMA)
    mixed = _tuples(stages["source_mixing"](spark, third, scratch))
    assert set(mixed) <= set(single) and 0 < len(mixed) <= len(single)
    shares = {(r["margin"], r["value"]): r for r in mixing.margin_shares(third).collect()}
    assert all(abs(r["reached"] - r["target"]) < 0.02 for r in shares.values() if r["margin"] == "source")

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path(corpus_pipeline.PIECES))
    got = corpus_pipeline.run(spark, scratch).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r[0], lib.encode(r[1])) for r in mixed)
    assert all(r.round_trip for r in got)


def test_stages_take_empty_tables(spark, scratch):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, scratch)
        assert out.collect() == []
        assert name == "sentencepiece" or out.columns == empty.columns
