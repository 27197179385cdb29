"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q and length of at least
max(least, 2 q) that can't be extended by a word without losing the period.

Many texts are worked side by side; every text has symbols of its own, so nothing
matches across texts.

* ``prefix_classes`` sorts all suffixes by prefix doubling: the suffix array, and for
  every k the class of the 2**k words from a position on (the first suffix array
  place of those that begin alike).  Two lookups by falling k give the longest common
  extension of two positions to the right or to the left, exactly.
* ``WaveletTree`` over the positions in suffix array order answers range successor:
  the first occurrence at or after v among the suffixes [lo, hi).  Only suffixes whose
  first block occurs again in their text stand in it.
* A run of period q holds, within its first words, a dyadic block: 2**k words at a
  multiple of 2**(k-1), with k by q.  That block occurs again q words further.  So each
  block asks for its occurrences in the neighbouring window of its level's periods.
* Occurrences no more than half a block apart form an arithmetic progression, whose
  difference r is the block's own period.  If block and progression lie in one
  r-periodic stretch, r is the only period of interest; if the stretches touch, every
  member of the progression may end a run; otherwise only members that align the ends
  of the two stretches.  All other occurrences are candidates one by one.
* A candidate period is extended both ways; what is long enough is a run.

Every run is found: the candidates are complete, and each is checked word by word
through the classes.  n words cost O(n log n) time and, per level, four bytes a word.

Cases: a null or empty text has no words and no run; a null key is a key like others;
repeated rows are rows like others; columns besides key and text are not read.  One
text is worked in one task, however long.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, text_or_empty, words

LEAST = 12                                 # words of a run, at least
BATCH_WORDS = 400_000                      # words worked side by side (a longer text alone)


def prefix_classes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Suffix array, classes by k, and by k the (first place, size) of classes with two or more members.

    The symbols must end with one that occurs nowhere else, and so must every text among them.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable").astype(np.int32)
    key, places, step = symbols[sa], np.arange(n, dtype=np.int32), 1
    rank = np.empty(n, np.int32)
    classes, shared = [], []
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        rank = rank.copy()
        rank[sa[places]] = np.repeat(places[first], size)
        classes.append(rank)
        several = size > 1
        shared.append((places[first[several]], size[several].astype(np.int32)))
        places = places[np.repeat(several, size)]
        if not len(places):
            return sa, classes, shared
        at = sa[places]
        key = rank[at].astype(np.int64) * n + rank[at + step]
        order = np.argsort(key, kind="stable")
        sa[places], key = at[order], key[order]
        step *= 2


def extend_right(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i and j (i <> j)."""
    out = np.zeros(len(i), np.int64)
    for k in reversed(range(len(classes))):
        out += (classes[k][i + out] == classes[k][j + out]).astype(np.int64) << k
    return out


def extend_left(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols directly before i and j (i < j) agree."""
    out = np.zeros(len(i), np.int64)
    for k in reversed(range(len(classes))):
        a, b = i - out - (1 << k), j - out - (1 << k)
        same = (a >= 0) & (classes[k][np.maximum(a, 0)] == classes[k][np.maximum(b, 0)])
        out += same.astype(np.int64) << k
    return out


class WaveletTree:
    """Levels of zero counts, highest bit first, over non-negative values."""

    def __init__(self, values: np.ndarray):
        self.levels, self.n = [], len(values)
        for bit in reversed(range(max(1, int(values.max(initial=0)).bit_length()))):
            zero = (values >> bit & 1) == 0
            before = np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)
            self.levels.append((bit, before))
            values = np.concatenate([values[zero], values[~zero]])

    def count_below(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many of the values at [lo, hi) are less than v."""
        lo, hi, out = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        over = v >> len(self.levels) > 0
        for bit, before in self.levels:
            a, b, zeros = before[lo], before[hi], before[-1]
            one = (v >> bit & 1) == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return np.where(over, -1, out)

    def select(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest (from 0) of the values at [lo, hi)."""
        lo, hi, nth, out = lo.copy(), hi.copy(), nth.copy(), np.zeros(len(lo), np.int64)
        for bit, before in self.levels:
            a, b, zeros = before[lo], before[hi], before[-1]
            one = nth >= b - a
            nth = np.where(one, nth - (b - a), nth)
            out |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The least value of at least v at [lo, hi); -1 where there is none."""
        below = self.count_below(lo, hi, v)
        some = (below >= 0) & (below < hi - lo)
        out = np.full(len(lo), -1, np.int64)
        out[some] = self.select(lo[some], hi[some], below[some])
        return out


def base_level(least: int) -> int:
    """The largest k whose blocks lie, for every period of that level or below, within a run's first words."""
    k = 0
    while 3 * (2 << k) - 3 <= least:
        k += 1
    return k


def find_runs(symbols: np.ndarray, starts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs, in order of start, then period.

    ``starts`` has the first position of each text; each text ends with a symbol of its own.
    """
    _, classes, shared = found = prefix_classes(symbols)
    base = base_level(least)
    if len(shared) <= base or not len(shared[base][0]):
        return np.zeros((0, 3), np.int64)
    first, size = shared[base]
    offset = np.concatenate([[0], np.cumsum(size)])             # places of the repeated suffixes, without gaps
    places = np.repeat(first - offset[:-1], size) + np.arange(offset[-1])
    at = found[0][places].astype(np.int64)
    tree = WaveletTree(at - starts[np.searchsorted(starts, at, "right") - 1])
    xs, qs = [], []
    for k in range(base, len(shared)):
        first, size = shared[k]
        if not len(first):
            break
        x = np.arange(0, len(symbols), max(1, 1 << k >> 1))
        c = np.minimum(np.searchsorted(first, classes[k][x]), len(first) - 1)
        again = first[c] == classes[k][x]
        x, c = x[again], c[again]
        lo = np.searchsorted(places, first[c])
        least_q = 1 if k == base else (3 << k >> 1) - 1
        for x_, q in _candidates(classes, tree, starts, k, x, lo, lo + size[c], least_q, max(1, (3 << k) - 2)):
            xs.append(x_)
            qs.append(q)
    if not xs:
        return np.zeros((0, 3), np.int64)
    pairs = np.unique(np.stack([np.concatenate(xs), np.concatenate(qs)], 1), axis=0)
    x, q = pairs[:, 0], pairs[:, 1]
    start = x - extend_left(classes, x, x + q)
    end = x + q + extend_right(classes, x, x + q)
    long = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))                          # of equal stretches, the smallest period
    start, end, q = start[order], end[order], q[order]
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(q) else np.zeros(0, bool)
    out = np.stack([start[keep], end[keep], q[keep]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _candidates(classes, tree: WaveletTree, starts, k: int, x, lo, hi, least_q: int, most_q: int):
    """Yields (block, period) arrays: the candidate periods of blocks x, whose occurrences stand at [lo, hi)."""
    own = starts[np.searchsorted(starts, x, "right") - 1]
    v = x + least_q
    while len(x):
        one = tree.successor(lo, hi, v - own) + own
        live = (one >= v) & (one <= x + most_q)
        x, lo, hi, own, one = x[live], lo[live], hi[live], own[live], one[live]
        two = tree.successor(lo, hi, one + 1 - own) + own
        r = two - one
        many = (two > one) & (r <= 1 << k >> 1)
        yield x[~many], one[~many] - x[~many]
        v = one + 1
        at = np.flatnonzero(many)
        if len(at):
            bx, o, d = x[at], one[at], r[at]
            a1, b1 = bx - extend_left(classes, bx, bx + d), bx + d + extend_right(classes, bx, bx + d)
            a2, b2 = o - extend_left(classes, o, o + d), o + d + extend_right(classes, o, o + d)
            end = np.minimum(bx + most_q, b2 - (1 << k))
            last = end - (end - o) % d
            v[at] = last + 1
            same = a1 == a2
            yield bx[same & (o - bx == d)], d[same & (o - bx == d)]
            touch = ~same & (b1 >= a2)
            n = (last[touch] - o[touch]) // d[touch] + 1
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(bx[touch], n), np.repeat(o[touch] - bx[touch], n) + nth * np.repeat(d[touch], n)
            for q in (a2 - a1, b2 - b1):
                ok = ~same & ~touch & (q >= o - bx) & (q <= last - bx) & ((q - (o - bx)) % d == 0)
                yield bx[ok], q[ok]


def runs_of(texts: Iterable[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """For each list of words its runs: rows (start, end, period)."""
    symbols, starts, base, at = [], [], 0, 0
    for w in texts:
        ids: dict[bytes, int] = {}
        row = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, len(w))
        symbols += [row + base, [base + len(ids)]]
        starts.append(at)
        base += len(ids) + 1
        at += len(w) + 1
    if not starts:
        return []
    starts = np.array(starts, np.int64)
    found = find_runs(np.concatenate(symbols).astype(np.int64), starts, least)
    owner = np.searchsorted(starts, found[:, 0], "right") - 1
    found[:, :2] -= starts[owner, None]
    return np.split(found, np.searchsorted(owner, np.arange(1, len(starts))))


def collapsed(w: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return w
    depth = np.zeros(len(w) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    keep = np.cumsum(depth)[:-1] == 0
    return [x for x, k in zip(w, keep) if k]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs array of (start, length, period), collapsed text) of every row."""
    prepare(docs.sparkSession)
    if least < 2:
        raise ValueError("a run has two words or more")
    kind = docs.schema[key].dataType.simpleString()

    def task(batches):
        keys, texts, size = [], [], 0

        def rows():
            found = runs_of(texts, least)
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            ends = np.cumsum([0, *map(len, found)])
            each = pa.StructArray.from_arrays(
                [pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])],
                names=["start", "length", "period"])
            kept = [b" ".join(collapsed(w, f)).decode() for w, f in zip(texts, found)]
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys), pa.array([len(w) for w in texts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array(kept, pa.string())],
                names=["key", "n_words", "runs", "collapsed"])
            keys.clear()
            texts.clear()
            return out

        for batch in batches:
            a = 0
            for i, t in enumerate(batch.column(1)):
                texts.append(t.as_py().encode().split())
                size += len(texts[-1])
                if size >= BATCH_WORDS:
                    keys.append(batch.column(0).slice(a, i + 1 - a))
                    a, size = i + 1, 0
                    yield rows()
            if a < len(batch):
                keys.append(batch.column(0).slice(a))
        if texts:
            yield rows()

    found = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("t")).mapInArrow(
        task, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("key", key)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in texts whose h = crc32(doc_id) divides by 10, words from a on repeat with period p.

    a = g % n and p = 1 + (n - a) div (3 + g % 8) for n words and g = h div 10.  A row without a doc_id stays as it is.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"),
                       F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    rows = rows.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("transform(w, (x, i) -> if(i < a, x, get(w, a + (i - a) % p)))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(planted(docs))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as l, -r.start as s, -r.period as p)))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
