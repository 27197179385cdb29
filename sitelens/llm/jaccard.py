"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct word shingles (64-bit hashes).  Documents with
equal sets share one representative before anything else happens.  Shingle size and
least similarity are parameters; the defaults are those of the op6 query.

Index: sets are ordered rare shingles first.  Frequencies come from a table of counters
that every shingle of every distinct set of a task adds to; the table grows with the
corpus (shingles that share a counter only blur the order, and any order gives right results).  Only
prefixes are indexed, as lists (shingle; set, size, position).  They are longer than
one common shingle would ask for: two linked sets, the smaller of n shingles, meet in
at least ``meetings(n)`` lists, and pairs that meet in fewer are never fetched.

Answers from similar sets: going through a list by size, each set is first checked
against one pivot only.  Sets found similar form components and take the pivot's
answers: pairs within a component are never looked at again, so a group of m near
copies costs about m checks.  What is left are pairs of different components that
meet in a list.  A list is then a few blocks (pivot; least and greatest size and
position of its members), blocks whose sizes or positions rule a link out are
skipped - a position counts only the shingles before it that lie in lists of two
components, no others can be common - and a set is checked against a block's pivot
if the lists they meet in leave a link possible.  By the triangle inequality
of the Jaccard distance, only if it is within
1 - percent / 100 + d(pivot, member) of the pivot can it link with a member, and only those members are checked.  No link between
different components can be missed, so components are exact.

Checks fetch sets by recomputing them from the documents in question, selected by a
bit map that grows with the number of sets; sets of other documents hardly ever leave their task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, salted_join, stored, text_or_empty
from sitelens.llm.graph import components

SHINGLE = 4
PERCENT = 85
CHARS_PER_COUNTER = 64                     # of text; the counters of shingle frequencies grow with the corpus
LEAST_COUNTERS, MOST_COUNTERS = 20, 26     # as powers of two: 1 to 64 MB to broadcast
CELL = 1 << 16                             # counters of one row while they are summed
CHUNK = 1_000_000                          # shingles counted at once in a task
LEAST_MAP, MOST_MAP = 22, 28               # bits of the map of wanted sets, as powers of two: at most 32 MB
NULL_KEY = -(2 ** 63)                      # stands for a null key; counts as the smallest
_CACHE: dict[bytes, int] = {}
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _word_hashes(ws: list[bytes]) -> np.ndarray:
    if len(_CACHE) > 400_000:
        _CACHE.clear()
    out = []
    for w in ws:
        h = _CACHE.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= 64:
                _CACHE[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than a shingle make one, no words make none."""
    ws = text.encode().lower().split()
    if not ws:
        return np.zeros(0, np.int64)
    h = _word_hashes(ws)
    span = min(size, len(h))
    x = np.zeros(len(h) - span + 1, np.uint64) + np.uint64(span)
    for i in range(span):
        x = (x ^ h[i:len(h) - span + 1 + i]) * _A
        x ^= x >> np.uint64(31)
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return np.unique((x ^ (x >> np.uint64(31))).view(np.int64))


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(na, nb, percent: int = PERCENT):
    """Least intersection size of a linked pair."""
    return -(-percent * (na + nb) // (100 + percent))


def meetings(n, percent: int = PERCENT):
    """Least number of lists in which linked sets meet, if the smaller one has n shingles."""
    return 1 + (100 - percent) * n // 500


def _met_enough(n: Column, percent: int) -> Column:
    return F.col("met") >= 1 + F.floor((100 - percent) * n / 500)


def _beyond(n: Column, percent: int) -> Column:
    """How many shingles of a set of n are not indexed."""
    return F.greatest(F.lit(0), F.ceil(percent * n / F.lit(100)) - 1 - F.floor((100 - percent) * n / 500))


def _survey(rows: DataFrame, span: int, counters: int) -> DataFrame:
    """Rows (kind 0: key, set id, size) per document and (kind 1: cell, compressed counters) per task."""
    def task(batches):
        table, held, size, seen = np.zeros(counters, np.uint32), [], 0, set()

        def count():
            at, n = np.unique(np.concatenate(held).view(np.uint64) & np.uint64(counters - 1), return_counts=True)
            table[at] += n.astype(np.uint32)

        for batch in batches:
            ids, ns = [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), span)
                ids.append(set_id(s) if len(s) else None)
                ns.append(len(s))
                if len(s) and ids[-1] not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(ids[-1])
                    held.append(s)
                    size += len(s)
                if size >= CHUNK:
                    count()
                    held, size = [], 0
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([0] * len(ns), pa.int32()), "x": batch.column(0), "y": pa.array(ids, pa.int64()),
                "n": pa.array(ns, pa.int64()), "data": pa.nulls(len(ns), pa.binary())})
        if held:
            count()
        for c in range(0, counters, CELL):
            cell = table[c:c + CELL]
            if cell.any():
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([1], pa.int32()), "x": pa.array([c // CELL], pa.int64()),
                    "y": pa.array([None], pa.int64()), "n": pa.array([0], pa.int64()),
                    "data": pa.array([zlib.compress(cell.tobytes(), 1)], pa.binary())})

    return rows.mapInArrow(task, "kind int, x long, y long, n long, data binary")


def _frequencies(survey: DataFrame, counters: int) -> np.ndarray:
    """The summed counters in steps of an eighth of a power of two, one byte each."""
    spark = survey.sparkSession
    parts = min(counters // CELL, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def task(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                cell = np.frombuffer(zlib.decompress(data.as_py()), np.uint32)
                sums[x] = sums[x] + cell if x in sums else cell.astype(np.uint64)
        for x, c in sums.items():
            steps = np.minimum(255, np.floor(8 * np.log2(c + 1.0))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"x": pa.array([x], pa.int64()), "steps": pa.array([steps.tobytes()], pa.binary())})

    cells = survey.filter("kind = 1").select("x", "data").repartition(max(1, parts), "x").mapInArrow(task, "x long, steps binary")
    out = np.zeros(counters, np.uint8)
    got = cells.toArrow()                                                # ``counters`` bytes in all
    for x, steps in zip(got.column("x").to_pylist(), got.column("steps")):
        out[x * CELL:(x + 1) * CELL] = np.frombuffer(steps.as_py(), np.uint8)
    return out


def _index(rows: DataFrame, steps: np.ndarray, span: int, percent: int) -> DataFrame:
    """Rows (token, id, n, pos): the prefixes of all distinct sets of each task, rare shingles first."""
    shared = rows.sparkSession.sparkContext.broadcast(steps)             # at most 2 ** MOST_COUNTERS bytes

    def task(batches):
        steps = shared.value
        mask = np.uint64(len(steps) - 1)
        seen: set[int] = set()
        for batch in batches:
            cols = [[], [], [], []]
            for t in batch.column(1):
                s = shingle_set(t.as_py(), span)
                if not len(s):
                    continue
                i = set_id(s)
                if i in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(i)
                n = len(s)
                size = min(n, n - -(-percent * n // 100) + meetings(n, percent))
                # By frequency, then by value: the sets are sorted by value.
                s = s[np.argsort(steps[s.view(np.uint64) & mask], kind="stable")]
                cols[0].append(s[:size])
                cols[1].append(np.full(size, i))
                cols[2].append(np.full(size, n))
                cols[3].append(np.arange(size))
                if sum(map(len, cols[0][-64:])) > 200_000 or len(cols[0]) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols],
                                                     ["token", "id", "n", "pos"])
                    cols = [[], [], [], []]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols],
                                                 ["token", "id", "n", "pos"])

    return rows.mapInArrow(task, "token long, id long, n long, pos long")


def _lists(index: DataFrame, percent: int) -> DataFrame:
    """Stream sorted lists: rows (kind 0: entry) of lists with two sets or more, (kind 1: pivot a, set b) to check."""
    spark = index.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_list = index.repartition(parts, "token").sortWithinPartitions("token", "n", "id")

    def task(batches):
        token = first = last = pivot = None    # of the current list: first entry if not yet given out
        for batch in batches:
            t, i, n, p = (c.to_numpy() for c in batch.columns)
            # Entries that share no list with a neighbour are passed over in one go.
            near = np.ones(len(t), bool)
            near[1:-1] = (t[1:-1] == t[:-2]) | (t[1:-1] == t[2:])
            out = []
            for k in np.flatnonzero(near).tolist():
                e = (int(t[k]), int(i[k]), int(n[k]), int(p[k]))
                if e[0] != token:
                    token, first, last, pivot = e[0], e, e, e
                    continue
                if e[1] == last[1]:            # the same set from another task
                    continue
                last = e
                if first is not None:
                    out.append((0, *first, 0))
                    first = None
                out.append((0, *e, 0))
                if 100 * pivot[2] < percent * e[2]:
                    pivot = e                  # too short for this and all later sets
                    continue
                most = min(pivot[3], e[3]) + 1 + min(pivot[2] - pivot[3], e[2] - e[3]) - 1
                if most >= needed(pivot[2], e[2], percent):
                    out.append((1, token, pivot[1], min(pivot[2], e[2]), 0, e[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 ["kind", "token", "id", "n", "pos", "other"])

    return by_list.mapInArrow(task, "kind long, token long, id long, n long, pos long, other long")


def _checked(pairs: DataFrame, sets: DataFrame, rows: DataFrame, floor: float, span: int,
             percent: int, map_bits: int) -> DataFrame:
    """Rows (a, b, j, linked) of the pairs of set ids whose Jaccard similarity is ``floor`` or more."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(sets, "id").select("key")
    bit = F.pmod(F.xxhash64("key"), F.lit(1 << map_bits))
    words = wanted.select(bit.alias("bit")).selectExpr(
        "cast(bit div 32 as int) as w", "shiftleft(1L, cast(bit % 32 as int)) as v")
    got = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()        # at most 2 ** (map_bits - 5) rows
    bits = np.zeros(1 << (map_bits - 5), np.uint32)
    bits[got.column("w").to_numpy()] = got.column("v").to_numpy().astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def fetch(batches):
        held = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            for k in np.flatnonzero((held[at >> 5] >> (at & 31).astype(np.uint32)) & 1).tolist():
                s = shingle_set(batch.column(1)[k].as_py(), span)
                if len(s):
                    yield pa.RecordBatch.from_pydict({"id": pa.array([set_id(s)], pa.int64()),
                                                      "s": pa.array([s.tobytes()], pa.binary())})

    found = rows.select("key", "t", bit.cast("long").alias("bit")).mapInArrow(fetch, "id long, s binary")
    # One shuffle of the fetched sets serves both joins; false hits of the bit map meet no pair.
    joined = pairs.select("a", "b").distinct().join(found.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    joined = joined.join(found.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")

    def compare(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            js, linked = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                js.append(both / union)
                linked.append(100 * both >= percent * union)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "j": js, "linked": linked})

    out = joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, j double, linked boolean")
    return out.filter(F.col("j") >= floor).distinct()


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SHINGLE,
                   percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id, n_equal.

    Documents link when 100 * intersection >= percent * union of their sets of shingles
    of ``span`` words; component_id is the smallest key reachable by links.  Words are runs of
    characters other than white space, A-Z lower-cased.  A text without words (or
    null) has an empty set, links with nothing and is its own component.  A null key
    counts as the smallest.  Repeated rows are documents with equal sets.  n_equal is
    the number of documents with the same set.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), text_or_empty(text).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    counters = 1 << min(MOST_COUNTERS, max(LEAST_COUNTERS, (chars // CHARS_PER_COUNTER).bit_length()))
    survey = stored(_survey(rows, span, counters), "jaccard-survey")
    of_doc = survey.filter("kind = 0").select(F.col("x").alias("key"), F.col("y").alias("id"), "n")
    sets = of_doc.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.count(F.lit(1)).alias("n_equal")).checkpoint()
    map_bits = min(MOST_MAP, max(LEAST_MAP, (4 * sets.count()).bit_length()))

    lists = stored(_lists(_index(rows, _frequencies(survey, counters), span, percent), percent), "jaccard-lists")
    # A pair that is split over several pivots may be passed over here: the block step finds it.
    to_pivot = lists.filter("kind = 1").groupBy(F.col("id").alias("a"), F.col("other").alias("b")).agg(
        F.count(F.lit(1)).alias("met"), F.first("n").alias("n")).filter(_met_enough(F.col("n"), percent))
    by_key = lambda links: (
        links.join(sets.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b")
        .select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    first = _checked(to_pivot, sets, rows, percent / 100 - 1e-9, span, percent, map_bits).filter("linked").checkpoint()
    label = components(first.select("a", "b"))
    pivots = first.groupBy(F.col("b").alias("id")).agg(F.min(F.struct(F.col("a").alias("p"), "j")).alias("x")).select(
        "id", "x.p", "x.j")

    # Lists as blocks of one pivot's members; blocks of one component never meet.
    entries = lists.filter("kind = 0").select("token", "id", "n", "pos").distinct()
    entries = entries.join(label.withColumnRenamed("node", "id"), "id", "left").join(pivots, "id", "left").select(
        "token", "id", "n", "pos", F.coalesce("label", "id").alias("label"), F.coalesce("p", "id").alias("p"))
    entries = entries.checkpoint()
    mixed = entries.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    # Only shingles of such lists can be common to sets of two components: ``q`` of them stand before a position.
    entries = entries.join(mixed.select("token"), "token", "left_semi").withColumn(
        "q", F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1).checkpoint()
    blocks = entries.groupBy("token", "label", "p").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"),
        F.max("q").alias("q1"), F.min("id").alias("i0"), F.max("id").alias("i1"))
    blocks = blocks.withColumnRenamed("label", "block_label").withColumnRenamed("p", "pivot")
    least = F.ceil(F.lit(percent) * (F.col("n") + F.col("n0")) / (100 + percent))
    most = F.least("q", "q1") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n1") - F.col("p0") - 1)
    probes = entries.join(blocks, "token").filter(
        (F.col("block_label") < F.col("label")) & (100 * F.col("n1") >= percent * F.col("n"))
        & (100 * F.col("n") >= percent * F.col("n0")) & (most >= least))
    probes = probes.groupBy(F.col("pivot").alias("a"), F.col("id").alias("b"), "n").agg(
        F.count(F.lit(1)).alias("met"), F.min("n0").alias("n0"), F.max("n1").alias("n1"),      # a list has one block a pivot
        F.max("pos").alias("x"), F.max("p1").alias("y"), F.min("i0").alias("i0"), F.max("i1").alias("i1"))
    # Common shingles up to the end of the shorter prefix have all been met; the others lie beyond it.  With one
    # member only, those that have not been met come after the last that has.
    least = F.ceil(F.lit(percent) * (F.col("n") + F.col("n0")) / (100 + percent))
    after = F.when(F.col("i0") == F.col("i1"), F.least(F.col("n") - F.col("x") - 1, F.col("n1") - F.col("y") - 1))
    beyond = F.greatest(_beyond(F.col("n"), percent), _beyond(F.col("n1"), percent))
    probes = probes.filter((F.col("met") + F.least(beyond, F.coalesce(after, beyond)) >= least)
                           & _met_enough(F.least("n", "n0"), percent)).select("a", "b")
    second = _checked(probes, sets, rows, 1 - 2 * (1 - percent / 100) - 1e-9, span, percent, map_bits).checkpoint()

    # Members of a near pivot that the triangle inequality leaves.
    members = pivots.select(F.col("p").alias("a"), F.col("id").alias("member"), F.col("j").alias("jm"))
    third = second.select("a", "b", "j").join(members, "a").filter(
        (1 - F.col("j")) <= (1 - F.col("jm")) + (1 - percent / 100) + 1e-9)
    third = third.select(F.col("member").alias("a"), "b").filter("a <> b").distinct()
    third = _checked(third, sets, rows, percent / 100 - 1e-9, span, percent, map_bits)
    links = first.filter("linked").select("a", "b").union(second.filter("linked").select("a", "b")).union(
        third.filter("linked").select("a", "b"))
    group = components(by_key(links))
    of_set = sets.join(group.withColumnRenamed("node", "key"), "key", "left").select(
        "id", F.coalesce("label", "key").alias("component"), "n_equal")
    out = salted_join(of_doc, of_set, ["id"], F.col("key"), "left")
    real = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return out.withColumn("component", F.coalesce("component", "key")).select(
        real("key").alias(key), F.col("n").alias("n_shingles"), real("component").alias("component_id"),
        F.coalesce("n_equal", F.lit(1).cast("long")).alias("n_equal"))
