"""Source divergence audit: term shares of every source against the other sources and its language.

Two passes over the texts.  The first counts, exactly, in how many documents of a
language a term occurs, and keeps the frequent terms.  These are split by hash into
shards of bounded size, and each shard gets a minimal perfect hash: levels of bits, a
key taking the first level where its bit is its own, its slot the number of bits set
before.  The terms stand beside it in slot order, so that a lookup is verified by the
stored term and a term that isn't a key is never counted.

The second pass looks every term of a text up in the broadcast shards and adds to a
dense array of slots per (language, source) group.  Only shards of the most frequent
terms are broadcast, as many as HEAD_BYTES holds (a bound that does not grow with the
data); a task passes on what it does not find there, and those counts meet the
remaining shards' perfect hashes shard by shard.  Nothing is lost either way.

Shares, differences and sums are exact integers.

Cases: null texts, languages and sources are ''; a group whose documents hold no term
has shares like others; a language without kept terms gives pairs of value 0; an empty
table gives no rows; repeated rows and rows that share an id or have none are documents
of their own; columns besides text, lang and source are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelens.llm.common import prepare, stored, text_or_empty

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 10                            # documents of a language in which a kept term occurs, at least
TOP = 10                                   # ranks of the terms of a group
UNIT = 1_000_000_000                       # shares are parts of this
HEAD_BYTES = 32 << 20                      # of terms in the broadcast shards
SHARD_TERMS = 4096                         # terms of a shard, about
DENSE = 4 << 20                            # numbers in the table of a shard's slots by sources, about
HELD_TERMS = 400_000                       # distinct terms counted in a task before they are passed on
HELD_SLOTS = 8 << 20                       # slots counted in a task before they are passed on
LEVELS, ROOM = 24, 2                       # levels of a perfect hash, bits per key on each


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased (bytes above 0x7F belong to other characters, all kept)."""
    return TERM.findall(text.encode().lower())


def hashes_of(terms: list[bytes]) -> np.ndarray:
    """64-bit hashes of terms, the same in every process."""
    out = np.empty(len(terms), object)
    out[:] = terms
    return pd.util.hash_array(out, categorize=False)


def _place(hashes: np.ndarray, level: int, size) -> np.ndarray:
    x = (hashes ^ np.uint64(level * 0xD1342543DE82EF95 + 1 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build(hashes: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """A minimal perfect hash: slot order of the keys, bits per level, the bits.

    Keys that no level separates (equal hashes) come last and are found by their terms alone.
    """
    order, sizes, bits, left = [], [], [], np.arange(len(hashes))
    for level in range(LEVELS):
        if not len(left):
            break
        size = ROOM * len(left)
        place = _place(hashes[left], level, size)
        count = np.bincount(place, minlength=size)
        alone = count[place] == 1
        order.append(left[alone][np.argsort(place[alone])])
        sizes.append(size)
        bits.append(count == 1)
        left = left[~alone]
    order.append(left)
    return np.concatenate(order), sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


class PerfectHash:
    """The shards of one language side by side: slots of terms, verified by the stored terms."""

    def __init__(self, shards: list[tuple[list[int], np.ndarray, pa.Array]]):
        self.n = len(shards)
        self.sizes = np.zeros((self.n, LEVELS), np.int64)
        for i, (sizes, _, _) in enumerate(shards):
            self.sizes[i, :len(sizes)] = sizes
        self.offsets = (np.cumsum(self.sizes) - self.sizes.ravel()).reshape(self.sizes.shape)
        self.base = np.concatenate([[0], np.cumsum([len(t) for _, _, t in shards])])
        self.bits = np.concatenate([b for _, b, _ in shards]).astype(bool)
        self.terms = pa.concat_arrays([t.cast(pa.large_binary()) for _, _, t in shards])
        self.slot, self.rest = np.full(len(self.bits), -1, np.int64), {}
        at = 0
        for i, (sizes, b, t) in enumerate(shards):
            own = at + np.flatnonzero(b)
            self.slot[own] = self.base[i] + np.arange(len(own))
            for j in range(len(own), len(t)):
                self.rest[t[j].as_py()] = int(self.base[i]) + j
            at += len(b)

    def find(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for one that isn't a key."""
        out = np.full(len(terms), -1, np.int64)
        shard = (hashes >> np.uint64(1)).astype(np.int64) % self.n
        left = np.arange(len(terms))
        for level in range(LEVELS):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            slot = self.slot[self.offsets[shard[left], level] + _place(hashes[left], level, size)]
            out[left] = slot
            left = left[slot < 0]
        some = np.flatnonzero(out >= 0)
        same = pc.equal(self.terms.take(pa.array(out[some])), pa.array([terms[i] for i in some], pa.large_binary()))
        out[some[~same.to_numpy(zero_copy_only=False).astype(bool)]] = -1
        for t in self.rest if self.rest else ():
            if t in terms:
                out[terms.index(t)] = self.rest[t]
        return out

    def shard_slot(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = np.searchsorted(self.base, slots, "right") - 1
        return shard, slots - self.base[shard]


def shares(counts: np.ndarray, total, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exact for totals below 9e15."""
    below = np.asarray(total, np.int64) + 2 * kept
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):                                   # three digits of the quotient at a time
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def document_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, term, n): in how many documents of the language the term occurs."""
    def task(batches):
        held: dict[str, Counter] = {}

        def rows():
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()),
                     pa.array(list(c.values()), pa.int64())], ["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Counter()).update(set(terms_of(t.as_py())))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from rows()
        yield from rows()

    return docs.select("lang", "text").mapInArrow(task, "lang string, term binary, n long").groupBy("lang", "term").agg(
        F.sum("n").alias("n"))


def _with_hash(kept: DataFrame) -> DataFrame:
    def task(batches):
        for b in batches:
            h = hashes_of(b.column("term").to_pylist()) if len(b) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64))], [*b.schema.names, "hash"])
    return kept.mapInArrow(task, "lang string, term binary, n long, hash long")


#: The shard of a hash; without the lowest bit it is no negative number, in numpy and in the JVM.
_SHARD = "cast(shiftrightunsigned(hash, 1) % shards as int)"


def _built(rows: DataFrame) -> DataFrame:
    """(lang, head, shard, sizes, bits, terms in slot order) of rows (lang, head, shard, term, hash)."""
    built = pa.schema([("lang", pa.string()), ("head", pa.bool_()), ("shard", pa.int32()), ("sizes", pa.list_(pa.int64())),
                       ("bits", pa.binary()), ("terms", pa.list_(pa.binary()))])

    def task(key, t):
        order, sizes, bits = build(t.column("hash").to_numpy().view(np.uint64))
        terms = t.column("term").combine_chunks().take(pa.array(order))
        one = dict(zip(("lang", "head", "shard"), (k.as_py() for k in key)))
        return pa.Table.from_pylist([one | {"sizes": sizes, "bits": np.packbits(bits).tobytes(), "terms": terms.to_pylist()}],
                                    schema=built)
    return rows.groupBy("lang", "head", "shard").applyInArrow(
        task, "lang string, head boolean, shard int, sizes array<long>, bits binary, terms array<binary>")


def _opened(row: dict) -> tuple[list[int], np.ndarray, pa.Array]:
    n = sum(row["sizes"])
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)
    return row["sizes"], bits, pa.array(row["terms"], pa.binary())


_OPEN: dict[str, dict[str, PerfectHash]] = {}


def _tables(name: str, shared) -> dict[str, PerfectHash]:
    """The broadcast shards by language, opened once per worker process."""
    if name not in _OPEN:
        _OPEN.clear()
        by: dict[str, dict[int, tuple]] = {}
        for row in pa.ipc.open_stream(shared.value).read_all().to_pylist():
            by.setdefault(row["lang"], {})[row["shard"]] = (_opened(row), row["shards"])
        none = ([], np.zeros(0, bool), pa.array([], pa.binary()))
        _OPEN[name] = {lang: PerfectHash([s.get(i, (none,))[0] for i in range(next(iter(s.values()))[1])])
                       for lang, s in by.items()}
    return _OPEN[name]


def _recount(docs: DataFrame, shared, name: str, rest: bool) -> DataFrame:
    """Rows (lang, source, shard, slot, term, hash, n): counts by slot of the broadcast shards, or by term beyond them."""
    def task(batches):
        tables = _tables(name, shared)
        held: dict[tuple[str, str], np.ndarray] = {}

        def batch_of(lang, source, **cols):
            n = len(cols["n"])
            kinds = {"shard": pa.int32(), "slot": pa.int32(), "term": pa.binary(), "hash": pa.int64(), "n": pa.int64()}
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                 *[pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in kinds.items()]],
                ["lang", "source", *kinds])

        def rows():
            for (lang, source), slots in held.items():
                at = np.flatnonzero(slots)
                shard, slot = tables[lang].shard_slot(at)
                yield batch_of(lang, source, shard=shard, slot=slot, n=slots[at])
            held.clear()

        for batch in batches:
            by: dict[tuple[str, str], Counter] = {}
            for lang, source, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                by.setdefault((lang, source), Counter()).update(terms_of(t.as_py()))
            for (lang, source), c in by.items():
                terms, n = list(c), np.fromiter(c.values(), np.int64, len(c))
                if not terms:
                    continue
                hashes = hashes_of(terms)
                found = np.full(len(terms), -1, np.int64)
                if lang in tables:
                    table = tables[lang]
                    found = table.find(terms, hashes)
                    if (lang, source) not in held:
                        if sum(map(len, held.values())) + len(table.terms) > HELD_SLOTS:
                            yield from rows()
                        held[lang, source] = np.zeros(len(table.terms), np.int64)
                    held[lang, source][found[found >= 0]] += n[found >= 0]
                if rest:
                    more = np.flatnonzero(found < 0)
                    yield batch_of(lang, source, term=[terms[i] for i in more],
                                   hash=hashes[more].view(np.int64), n=n[more])
        yield from rows()

    return docs.mapInArrow(task, "lang string, source string, shard int, slot int, term binary, hash long, n long")


def _rest_counts(rest: DataFrame, shards: DataFrame, sizes: DataFrame) -> DataFrame:
    """Counts of terms beyond the broadcast shards, by slot of the shard that holds them."""
    rest = rest.groupBy("lang", "source", "term", "hash").agg(F.sum("n").alias("n"))
    rest = rest.join(sizes.select("lang", F.col("tail_shards").alias("shards")), "lang").filter("shards > 0")
    rest = rest.withColumn("shard", F.expr(_SHARD)).select("lang", "shard", "source", "term", "hash", "n")
    tail = shards.filter("NOT head").select("lang", "shard", "sizes", "bits", "terms")
    schema = "lang string, shard int, source string, slot int, n long"

    def task(key, left, right):
        out = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("source", pa.string()), ("slot", pa.int32()),
                         ("n", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        table = PerfectHash([_opened(right.to_pylist()[0])])
        slot = table.find(left.column("term").to_pylist(), left.column("hash").to_numpy().view(np.uint64))
        left = left.set_column(0, "slot", pa.array(slot, pa.int32())).filter(pa.array(slot >= 0))
        n = left.num_rows
        return pa.table([pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int32()),
                         left.column("source"), left.column("slot"), left.column("n")], schema=out)

    return rest.groupBy("lang", "shard").cogroup(tail.groupBy("lang", "shard")).applyInArrow(task, schema)


def _shard_parts(top: int):
    """What one shard gives: per pair of sources the summed differences, per source its first terms."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()),
                        ("value", pa.int64())])

    def task(key, counts, shard):
        if not shard.num_rows:
            return schema.empty_table()
        s = shard.to_pylist()[0]
        names = [x["source"] for x in s["sources"]]
        at = {x: i for i, x in enumerate(names)}
        totals = np.array([x["n"] for x in s["sources"]], np.int64)
        terms = s["terms"]
        c = np.zeros((len(names), len(terms)), np.int64)
        if counts.num_rows:
            row = np.array([at[x] for x in counts.column("source").to_pylist()], np.int64)
            c[row, counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
        p = shares(c, totals[:, None], s["kept"])
        q = shares(c.sum(0), totals.sum(), s["kept"])
        out: list[tuple[str, str, str, int]] = []
        for i in range(len(names) - 1):
            d, e = p[i + 1:] - p[i], p[i + 1:] + p[i]
            out += [(names[i], "pair", names[i + 1 + j], int(v)) for j, v in enumerate((d * d // e).sum(1))]
        value = (p - q) * (p - q) // (p + q)
        for i, name in enumerate(names):
            some = np.flatnonzero((c[i] > 0) & (p[i] > q))
            if len(some) > top:
                some = some[value[i, some] >= np.partition(value[i, some], -top)[-top]]
            first = sorted(((-int(value[i, j]), terms[j]) for j in some))[:top]
            out += [(name, "term", t.decode(), -v) for v, t in first]
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()),
                         *[pa.array(x, f.type) for x, f in zip(cols, list(schema)[1:])]], schema=schema)

    return task


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language by divergence of term shares.
    Part ``term``: the first ``top`` terms that the source uses more than its language.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(text_or_empty("lang").cast("string").alias("lang"),
                       text_or_empty("source").cast("string").alias("source"), text_or_empty("text").alias("text"))
    kept = stored(_with_hash(document_counts(docs).filter(F.col("n") >= least_docs)), "divergence-terms")
    groups = stored(docs.select("lang", "source").distinct(), "divergence-groups")

    # The lowest class of document counts (by powers of two) from which on all terms fit the broadcast.
    level = F.expr("cast(floor(log2(n)) as int)")
    by_level = kept.groupBy(level.alias("level")).agg(F.sum(F.length("term") + 24).alias("size")).collect()
    head_from, size = 64, 0
    for r in sorted(by_level, reverse=True):
        size += r["size"]
        if size > head_bytes:
            break
        head_from = r["level"]
    kept = kept.withColumn("head", level >= head_from)
    all_head = size <= head_bytes

    per = F.greatest(F.lit(64), F.least(F.lit(SHARD_TERMS), F.expr(f"{DENSE} div sources")))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.count_if("head").alias("n_head")), "lang", "left")
    sizes = sizes.na.fill(0).select("lang", "kept", F.ceil(F.col("n_head") / per).alias("head_shards"),
                                    F.ceil((F.col("kept") - F.col("n_head")) / per).alias("tail_shards"))
    sizes = stored(sizes, "divergence-sizes")
    cut = kept.join(sizes, "lang").withColumn("shards", F.expr("if(head, head_shards, tail_shards)"))
    cut = cut.select("lang", "head", F.expr(_SHARD).alias("shard"), "term", "hash")
    shards = stored(_built(cut), "divergence-shards")

    head = shards.filter("head").join(sizes.select("lang", F.col("head_shards").cast("int").alias("shards")), "lang")
    table = head.toArrow()                               # at most about head_bytes
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    counted = _recount(docs, shared, uuid.uuid4().hex, not all_head)
    if all_head:
        counts = counted.groupBy("lang", "shard", "source", "slot").agg(F.sum("n").alias("n")).withColumn("head", F.lit(True))
    else:
        counted = stored(counted, "divergence-recount")
        inside = counted.filter("term IS NULL").groupBy("lang", "shard", "source", "slot").agg(F.sum("n").alias("n"))
        beyond = _rest_counts(counted.filter("term IS NOT NULL"), shards, sizes)
        counts = inside.withColumn("head", F.lit(True)).unionByName(beyond.withColumn("head", F.lit(False)))
    counts = stored(counts, "divergence-counts")
    shared.unpersist()

    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").na.fill(0)
    langs = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))
    langs = langs.join(sizes.select("lang", "kept"), "lang")
    right = langs.join(shards.select("lang", "head", "shard", "terms"), "lang", "left").select(
        "lang", F.coalesce("head", F.lit(True)).alias("head"), F.coalesce("shard", F.lit(0)).alias("shard"),
        F.coalesce("terms", F.expr("cast(array() as array<binary>)")).alias("terms"), "sources", "kept")
    keys = ["lang", "shard", "head"]
    parts = counts.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _shard_parts(top), "lang string, source string, part string, item string, value long")
    parts = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pair = F.col("part") == "pair"
    both = parts.withColumn("ends", F.when(pair, F.array(F.struct("source", "item"), F.struct(
        F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item"))))
    both = both.select("lang", "part", "value", F.explode("ends").alias("e")).select(
        "lang", F.col("e.source").alias("source"), "part", F.col("e.item").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return both.withColumn("rank", F.row_number().over(order)).filter(~pair & (F.col("rank") <= top) | pair)
