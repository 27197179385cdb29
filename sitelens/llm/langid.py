"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per (language, bucket) within tasks; Spark sums them over all
partitions; the driver turns the sums - one row per language and bucket, whatever
the corpus - into a matrix of log probabilities and broadcasts it.  Scoring takes
whole texts in batches: a text is a sparse row of n-gram buckets, and its sparse
product with the matrix is one gather and one segmented sum in numpy.  Logs are
fixed-point integers, so a text's sums do not depend on its batch.

Letters are lower-cased, each stretch of other characters is one word boundary.
Languages beyond MATRIX_BYTES of matrix are scored in further passes over the rows,
each with its own broadcast, so that the broadcast is bounded for any number of labels.

Cases: a null text, or one without a letter, is ``und`` with score 0; nothing learned
(no table rows, no labels) gives ``und`` for every row; equal posteriors go to the
first language in order; rows without a doc_id are never held out; repeated rows are
rows like others, and columns besides the named ones are not read.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, stored

GRAMS = (1, 2, 3)                          # n-gram lengths in code points (three of 21 bits fill a key)
BUCKETS = 1 << 16
SMOOTH = 0.5                               # added to every count
MATRIX_BYTES = 32 << 20                    # of log probabilities in one broadcast
HELD_BYTES = 64 << 20                      # of counts in a training task before they are passed on
PIECE = 1 << 20                            # code points worked on at once
SCALE = 1 << 20                            # of the fixed-point logs
UNKNOWN = "und"
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, false)"


@functools.cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-cased letter or mark (0: neither), and whether it is a letter."""
    fold, letter = np.zeros(0x110000, np.uint64), np.zeros(0x110000, bool)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            fold[c], letter[c] = ord(s.lower()[0]), True
        elif unicodedata.category(s)[0] == "M":
            fold[c] = c
    return fold, letter


def _hashed(keys: np.ndarray, order: int) -> np.ndarray:
    x = keys + np.uint64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ (x >> np.uint64(33))) % np.uint64(BUCKETS)


def pieces(texts: list[str]):
    """(owner, bucket) arrays of all n-grams of all texts, in bounded pieces; and per text whether it has a letter."""
    fold, letter = letter_tables()
    has = np.zeros(len(texts), bool)

    def grams():
        held, owners, size = [], [], 0
        for i, t in enumerate(texts):
            codes = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
            has[i] = letter[codes].any()
            if not has[i]:
                continue
            f = fold[codes]
            inner = np.concatenate([[True], (f[1:] != 0) | (f[:-1] != 0)])
            f = np.concatenate([np.zeros(1, np.uint64), f[inner], np.zeros(1, np.uint64)])
            for a in range(0, len(f), PIECE):                   # pieces overlap, so that no n-gram is cut
                held.append(f[a:a + PIECE + max(GRAMS) - 1])
                owners.append((i, min(PIECE, len(f) - a)))
                size += len(held[-1])
                if size >= PIECE:
                    yield from _grams(held, owners)
                    held, owners, size = [], [], 0
        yield from _grams(held, owners)

    return grams(), has


def _grams(held: list[np.ndarray], owners: list[tuple[int, int]]):
    if not held:
        return
    codes = np.concatenate(held)
    lengths = np.array([len(h) for h in held])
    piece = np.repeat(np.arange(len(held)), lengths)
    starts = np.cumsum(lengths) - lengths
    own = np.array([o for o, _ in owners])
    first_of_next = np.array([n for _, n in owners])            # n-grams that start later belong to the next piece
    inside = np.arange(len(codes)) - starts[piece] < first_of_next[piece]
    keys = codes.copy()
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            keys = keys[:-1] | codes[n - 1:] << np.uint64(21 * (n - 1))
        if n in GRAMS:
            last = len(codes) - n + 1
            ok = inside[:last] & (piece[:last] == piece[n - 1:]) & (keys != 0)
            yield own[piece[:last][ok]], _hashed(keys[ok], n).astype(np.int64)


def gram_counts(docs: DataFrame, label: str, text: str = "text") -> DataFrame:
    """Rows (label, bucket, n): n-grams per label and bucket; bucket -1 counts the texts with a letter."""
    prepare(docs.sparkSession)

    def task(batches):
        held: dict[str, np.ndarray] = {}

        def rows():
            for lang, c in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(c[at], pa.int64())],
                    ["label", "bucket", "n"])
            held.clear()

        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                if lang not in held and (len(held) + 1) * 8 * BUCKETS > HELD_BYTES:
                    yield from rows()
                c = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                found, has = pieces(texts)
                for _, buckets in found:
                    c[1:] += np.bincount(buckets, minlength=BUCKETS)
                c[0] += has.sum()
        yield from rows()

    labelled = docs.select(F.col(label).cast("string").alias("label"), F.col(text).alias("t"))
    labelled = labelled.filter("label IS NOT NULL AND t IS NOT NULL")
    return labelled.mapInArrow(task, "label string, bucket int, n long").groupBy("label", "bucket").agg(
        F.sum("n").alias("n"))


class Model:
    """Log probabilities (buckets x languages) and log priors in fixed point, for one block of languages."""

    def __init__(self, langs: list[str], logs: np.ndarray, prior: np.ndarray):
        self.langs, self.logs, self.prior = langs, logs, prior

    @classmethod
    def of(cls, langs: list[str], counts: pa.Table, texts: int) -> Model:
        at = {s: i for i, s in enumerate(langs)}
        lang = np.array([at[s] for s in counts.column("label").to_pylist()], np.int64)
        bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
        grams = np.zeros((BUCKETS + 1, len(langs)))
        grams[bucket + 1, lang] = n
        logs = np.log(grams[1:] + SMOOTH) - np.log(grams[1:].sum(0) + SMOOTH * BUCKETS)
        prior = np.log(np.maximum(grams[0], 0.5) / max(1, texts))
        return cls(langs, np.rint(logs * SCALE).astype(np.int32), np.rint(prior * SCALE).astype(np.int64))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the log joint probability (fixed point); per text whether it has a letter."""
        total = np.repeat(self.prior[None, :], len(texts), 0)
        step = max(1, 4_000_000 // len(self.langs))
        found, has = pieces(texts)
        for owner, bucket in found:
            for a in range(0, len(owner), step):
                o = owner[a:a + step]
                first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                total[o[first]] += np.add.reduceat(self.logs[bucket[a:a + step]], first, axis=0, dtype=np.int64)
        return total, has


def train(docs: DataFrame, label: str = "lang", text: str = "text") -> list[Model]:
    """Models of all labels of ``docs``, in blocks of at most MATRIX_BYTES of matrix, labels in order."""
    counts = stored(gram_counts(docs, label, text), "langid-counts")
    texts = counts.filter("bucket = -1").select("label", "n").toArrow()
    langs = sorted(texts.column("label").to_pylist(), key=lambda s: s.encode())
    total = sum(texts.column("n").to_pylist())
    block = max(1, MATRIX_BYTES // (4 * BUCKETS))
    parts = [langs[i:i + block] for i in range(0, len(langs), block)]
    return [Model.of(p, counts.filter(F.col("label").isin(p)).toArrow(), total) for p in parts]


def predict(docs: DataFrame, models: list[Model], text: str = "text", named: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``docs`` with the most probable language of each whole text and its posterior probability (0 to 1)."""
    spark = prepare(docs.sparkSession)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("t"),
                       F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("top"),
                       F.lit(0.0).alias("mass"))

    def scored(rows: DataFrame, model: Model) -> DataFrame:
        shared = spark.sparkContext.broadcast(model)

        def task(batches):
            m = shared.value
            for batch in batches:
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                total, has = m.totals(texts)
                best = total.argmax(1)
                top = total[np.arange(len(texts)), best]
                mass = np.exp((total - top[:, None]) / SCALE).sum(1)
                lang = batch.column(2).to_pylist()
                old, old_mass = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                wins = np.array([s is None for s in lang], bool) | (top > old)
                high = np.where(wins, top, old)
                mass = mass * np.exp(np.minimum(0, top - high) / SCALE)
                mass += old_mass * np.exp(np.where(old_mass > 0, np.minimum(0, old - high), 0) / SCALE)
                lang = [(m.langs[b] if w else s) if h else None for b, w, s, h in zip(best, wins, lang, has)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(high, pa.int64()),
                     pa.array(mass, pa.float64())], names=["row", "t", "lang", "top", "mass"])

        return rows.mapInArrow(task, rows.schema)

    for m in models:
        rows = scored(rows, m)
    share = F.when(F.col("lang").isNull(), F.lit(0.0)).otherwise(1 / F.col("mass"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names],
                       F.coalesce("lang", F.lit(UNKNOWN)).alias(named), share.alias(score))


def identify(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the labelled rows that are not held out."""
    out = F.expr(HELD_OUT) if held_out is None else held_out
    models = train(docs.filter(~out))
    return predict(docs.select("doc_id", "text", out.alias("held_out")), models).select(
        "doc_id", "held_out", "lang_pred", "score")
