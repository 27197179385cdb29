"""F8 stored postings against the row predicate."""

from __future__ import annotations

import random
import re

import pytest

from sitelens.operators.text_index import TextIndex
from sitelens.operators.text_search import match_rows

QUERIES = ["+alpha +beta", "+alpha -beta", "gamma delta", "+alpha +rare", "+nowhere +alpha", "-alpha", "al +be", "",
           "+alpha +beta +gamma -delta -rare", "gamma -alpha", "+straße", "+e-mail", "rare"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["alpha"] * 9 + ["beta"] * 5 + ["gamma", "delta", "Straße", "e-mail", "x", "of"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))) + (" RARE" if i % 37 == 0 else "")) for i in range(300)]
    return spark.createDataFrame(rows + [(1000, None), (None, "alpha beta")], "doc long, body string")


@pytest.mark.parametrize("broadcast_ids", [1_000_000, 0])
def test_equals_the_row_predicate(spark, docs, scratch, broadcast_ids):
    index = TextIndex(spark, f"{scratch}/i", buckets=8, broadcast_ids=broadcast_ids)
    index.add(docs, "doc", "body")
    for q in QUERIES:
        got = sorted({r["doc"] for r in index.rows(docs, "doc", q).collect()})
        assert got == sorted({r["doc"] for r in match_rows(docs.where("doc IS NOT NULL"), "body", q).collect()}), q


def test_segments_added_and_compacted_give_the_same_answers(spark, docs, scratch):
    one = docs.where("doc IS NOT NULL")
    whole, parts = TextIndex(spark, f"{scratch}/a", buckets=8), TextIndex(spark, f"{scratch}/b", buckets=8)
    whole.add(one, "doc", "body")
    parts.add(one.where("doc < 100"), "doc", "body", txn="first")
    parts.add(one.where("doc < 100"), "doc", "body", txn="first")          # retried
    assert len(parts.names()) == 1
    parts.add(one.where("doc >= 100"), "doc", "body")
    assert len(parts.names()) == 2
    answers = {q: sorted(r["doc"] for r in match_rows(one, "body", q).collect()) for q in QUERIES}
    for index in (whole, parts):
        assert {q: sorted(r["doc"] for r in index.rows(one, "doc", q).collect()) for q in QUERIES} == answers
    assert whole.frequencies(["alpha", "rare", "nope"]) == parts.frequencies(["alpha", "rare", "nope"])
    parts.compact()
    assert len(parts.names()) == 1
    assert {q: sorted(r["doc"] for r in parts.rows(one, "doc", q).collect()) for q in QUERIES} == answers


def test_search_opens_only_the_words_buckets_and_moves_no_common_posting(spark, docs, scratch):
    index = TextIndex(spark, f"{scratch}/i", buckets=8)
    index.add(docs, "doc", "body")
    plan = index.search("+alpha +rare")[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    assert "hashpartitioning" not in plan                     # the common word's postings meet broadcast ids
    assert index.frequencies(["rare"])["rare"] == 9


def test_empty_index(spark, docs, scratch):
    index = TextIndex(spark, f"{scratch}/i")
    assert index.rows(docs, "doc", "+alpha").collect() == []
    index.add(docs.limit(0), "doc", "body")
    assert index.rows(docs, "doc", "+alpha").collect() == []
