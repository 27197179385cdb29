"""Language-model scoring with a hidden Markov model.

The model: a hidden state per token emits a word class, the class emits the word.
The most frequent training words are classes of their own; all other words share
classes by hash, within which a word has its smoothed relative frequency, and one
share is left for unknown words.  A text ends with an end token.  So probabilities
over all words sum to one, and state tables have a fixed size whatever the
vocabulary.

Training: Baum-Welch.  Each task runs the scaled forward-backward recursion over
its texts (many texts side by side in numpy) and emits its expected counts; Spark
sums them over all partitions; the sums - a table of states x classes - give the
next parameters.  Every training text counts in every iteration.

Scoring: the scaled forward recursion gives the exact likelihood of the whole
text under the model.  The full vocabulary is never held in one place: texts meet
word counts block by block (``blocks``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.blocks import in_blocks, map_blocks, word_counts
from sitelens.llm.common import stored

STATES = 8
OWN_CLASSES = 2_047                        # words with a class of their own
SHARED_CLASSES = 256
OWN_CHARS = 64                             # longer words share classes
ITERATIONS = 4
BATCH_TOKENS = 400_000
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 1"
END = b""                                  # words are never empty


def cut(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, then the end token."""
    return [*text.encode().lower().split(), END]


class Hmm:
    """Start, transition and emission probabilities (emission[class, state])."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, shares: np.ndarray, states: int = STATES, seed: int = 0) -> Hmm:
        """Emissions scattered around the class shares; states that tend to stay."""
        rng = np.random.default_rng(seed)
        emit = (shares[:, None] + 1e-9) * rng.gamma(1.0, 1.0, (len(shares), states)) + 0.05 * shares[:, None]
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start, move, emit, shares: np.ndarray) -> Hmm:
        """Relative expected counts; small pseudo-counts keep every class possible in every state."""
        emit = emit + 5.0 * (shares[:, None] + 1e-7)
        move, start = move + 0.5, start + 0.5
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def _forward(self, obs: np.ndarray, lens: np.ndarray, keep: bool):
        """Texts (rows of ``obs``, longest first) side by side, one step per token."""
        n, longest = obs.shape
        active = np.searchsorted(-lens, -np.arange(longest), side="left")     # texts longer than t
        loglik, a = np.zeros(n), np.tile(self.start, (n, 1))
        alphas, scales = [], []
        for t in range(longest):
            m = active[t]
            a = (a if t == 0 else a[:m] @ self.move)[:m] * self.emit[obs[:m, t]]
            c = a.sum(1)
            a /= c[:, None]
            loglik[:m] += np.log(c)
            if keep:
                alphas.append(a)
                scales.append(c)
        return loglik, alphas, scales, active

    def loglik(self, obs, lens) -> np.ndarray:
        return self._forward(obs, lens, False)[0]

    def expected(self, obs, lens):
        """Expected start, transition and emission counts and the log likelihood."""
        loglik, alphas, scales, active = self._forward(obs, lens, True)
        k = len(self.start)
        moves, emits = np.zeros((k, k)), np.zeros_like(self.emit)
        beta, seen, gammas = np.ones((0, k)), [], []
        for t in range(obs.shape[1] - 1, -1, -1):
            m = active[t]
            full = np.ones((m, k))
            if len(beta):
                nxt = beta * self.emit[obs[:len(beta), t + 1]] / scales[t + 1][:, None]
                moves += alphas[t][:len(beta)].T @ nxt
                full[:len(beta)] = nxt @ self.move.T
            beta = full
            gammas.append(alphas[t] * beta)
            seen.append(obs[:m, t])
        gamma, words = np.concatenate(gammas), np.concatenate(seen)
        for s in range(k):
            emits[:, s] = np.bincount(words, gamma[:, s], len(emits))
        return gammas[-1].sum(0), moves * self.move, emits, float(loglik.sum())


def side_by_side(seqs: list[np.ndarray], most: int = BATCH_TOKENS):
    """Groups (indices, padded matrix, lengths) of texts of like length, longest first, of bounded size."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(seqs[order[at]]))
        some = order[at:at + max(1, most // longest)]
        obs = np.zeros((len(some), longest), np.uint16)
        for r, i in enumerate(some):
            obs[r, :len(seqs[i])] = seqs[i]
        yield some, obs, np.array([len(seqs[i]) for i in some])
        at += len(some)


def _expect(seqs: DataFrame, model: Hmm) -> tuple:
    """Expected counts over all sequences (column ``seq``), summed across partitions by Spark."""
    shapes = [model.start.shape, model.move.shape, model.emit.shape, (1,)]
    sizes = [int(np.prod(s)) for s in shapes]

    def task(batches):
        total = None
        for batch in batches:
            arrays = [np.frombuffer(b.as_buffer(), np.uint16) for b in batch.column(0)]
            for _, obs, lens in side_by_side(arrays):
                part = np.concatenate([np.ravel(x) for x in model.expected(obs, lens)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

    sums = seqs.mapInArrow(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(sum(sizes))
    for i, v in sums.collect():                # states x classes numbers: a fixed size
        flat[i] = v
    return tuple(x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: str = HELD_OUT, states: int = STATES,
          iterations: int = ITERATIONS, own: int = OWN_CLASSES, shared: int = SHARED_CLASSES) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts that meet ``held_out`` (an SQL condition on the key; a null key counts as
    training) are scored but not learned from.  ``base_score`` is the smoothed unigram log10
    probability, ``score`` the model's.  A null text is empty: its end token only.
    Repeated rows are scored, and learned from, each.  Without any training text all
    words are unknown and the states stay as initialised.  An empty table gives no rows.
    """
    test = F.coalesce(F.expr(held_out.replace("doc_id", key)), F.lit(False))
    counts = stored(word_counts(docs.filter(~test), cut, text), "hmm-counts")
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_tokens, n_words = total[0] or 0, total[1]
    head = counts.filter((F.octet_length("word") <= OWN_CHARS) & (F.octet_length("word") > 0))
    head = head.orderBy(F.desc("c"), "word").limit(own).collect()
    top = {END: 0} | {bytes(w): i + 1 for i, (w, _) in enumerate(head)}
    first = own + 1
    rest = counts.filter(~F.col("word").isin([bytes(w) for w, _ in head] + [END])) if head else counts.filter(
        F.octet_length("word") > 0)
    shared_n, shared_v = np.zeros(shared), np.zeros(shared)
    for c, n, v in rest.groupBy(F.pmod(F.crc32("word"), F.lit(shared)).alias("h")).agg(
            F.sum("c"), F.count(F.lit(1))).collect():
        shared_n[c], shared_v[c] = n, v
    ends = counts.filter(F.octet_length("word") == 0).agg(F.sum("c")).first()[0] or 0
    mass = np.zeros(first + shared)
    mass[0], mass[1:1 + len(head)], mass[first:] = ends, [c for _, c in head], shared_n
    shares = (mass + 0.5) / (mass + 0.5).sum()
    room = shared_n + 0.5 * (shared_v + 1)     # of a shared class: counts, half a count per word and for unknown words
    base_room = n_tokens + 0.5 * (n_words + 1)

    def work(texts, answers):
        words = [bytes(w) for w in answers.column("word").to_pylist()]
        index = {w: i for i, w in enumerate(words)}
        c = list(answers.column("c").to_pylist())
        cls = [top.get(w, first + zlib.crc32(w) % shared) for w in words]
        out = {"k": texts.column("k"), "n_tokens": [], "n_known": [], "base": [], "inner": [], "seq": []}
        known = len(words)
        cut_texts = []
        for t in texts.column("t"):
            ws = cut(t.as_py())
            ids = []
            for w in ws:
                i = index.get(w)
                if i is None:                  # not in the training texts
                    i = index[w] = len(cls)
                    c.append(0)
                    cls.append(top.get(w, first + zlib.crc32(w) % shared))
                ids.append(i)
            cut_texts.append(np.array(ids, np.int32))
        c, cls = np.array(c, float), np.array(cls, np.int64)
        base = np.log10((c + 0.5) / base_room)
        inner = np.where(cls >= first, np.log10((c + 0.5) / room[np.maximum(cls - first, 0)]), 0.0)
        for ids in cut_texts:
            out["n_tokens"].append(len(ids))
            out["n_known"].append(int((ids < known).sum()))
            out["base"].append(float(base[ids].sum()))
            out["inner"].append(float(inner[ids].sum()))
            out["seq"].append(cls[ids].astype("<u2").tobytes())
        return pa.table(out, schema=pa.schema([
            ("k", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
            ("inner", pa.float64()), ("seq", pa.binary())]))

    coded = map_blocks(in_blocks(docs, key, text), counts, cut, work,
                       "k long, n_tokens long, n_known long, base double, inner double, seq binary")
    coded = stored(coded.withColumnRenamed("k", key).withColumn("held_out", test), "hmm-coded")
    model = Hmm.initial(shares, states)
    training = coded.filter(~F.col("held_out")).select("seq")
    for _ in range(iterations):
        *sums, loglik = _expect(training, model)
        if not sums[0].sum():
            break
        model = Hmm.from_counts(*sums, shares)

    def likelihood(batches):
        for batch in batches:
            arrays = [np.frombuffer(b.as_buffer(), np.uint16) for b in batch.column("seq")]
            got = np.zeros(len(arrays))
            for some, obs, lens in side_by_side(arrays):
                got[some] = model.loglik(obs, lens) / np.log(10)
            got += batch.column("inner").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (key, "held_out", "n_tokens", "n_known", "base")], pa.array(got)],
                [key, "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = coded.mapInArrow(likelihood, f"{key} long, held_out boolean, n_tokens long, n_known long, "
                                          "base_score double, score double")
    return scored.select(key, "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")
