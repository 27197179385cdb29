"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut where no piece can reach across (before a run of spaces, between
characters that no piece holds side by side).  Each task numbers the distinct words
it meets and hands on every new word, then the texts as numbers of words.  The
bounded-length substrings of each new word are exploded and equi-joined to the piece
table: the edges of the word's lattice, folded to the best path:

* unigram models: Viterbi over end positions, best score first;
* BPE models: the path starts with single characters; every step takes the edge of
  the best score that covers two neighbouring parts of the path (leftmost on ties).
  Viterbi over the piece scores would not give the ids that the library defines for
  such a model, so the fold follows the model type.

Characters without a piece become byte pieces.  All of this is one chain of narrow steps: a
word's edges follow each other and stand before the texts that hold it, so neither
texts nor words are shuffled or stored, and a word is folded once per task (again after
HELD_WORDS others).  Decoding looks every id's bytes up and joins them, in DataFrame
functions only.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, text_or_empty

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


class Model:
    """The parts of a model file that encoding needs."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto if proto is not None else open(path, "rb").read())
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        self.kind = m.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.pieces = [(i, p.piece, p.score) for i, p in enumerate(m.pieces) if p.type == NORMAL]
        for _, p, _ in self.pieces:
            if re.search(f"[^{SPACE}]{SPACE}", p):
                raise ValueError(f"piece {p!r} reaches across a cut")
        #: Neighbouring characters that some piece holds; a word may be cut between any others.
        self.pairs = {p[i:i + 2] for _, p, _ in self.pieces for i in range(len(p) - 1)}
        self.longest = max(len(p) for _, p, _ in self.pieces)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.worst = min(s for _, _, s in self.pieces) - 10.0
        self.hexes = []
        for p in m.pieces:
            raw = (p.piece[3:5] if p.type == BYTE else "" if p.type == CONTROL
                   else (" ⁇ " if p.type == UNKNOWN else p.piece.replace(SPACE, " ")).encode().hex())
            self.hexes.append(raw)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, cost): a vocabulary file's worth of rows, so it may be broadcast."""
        rows = [(p, i, -float(s)) for i, p, s in self.pieces]
        return spark.createDataFrame(rows, "piece string, id int, cost double")


_PARTS: dict = {}


def cutter(pairs: set[str]):
    """A function that cuts a text into words: spaces shown as U+2581, after the dummy prefix; none if it is empty.

    A word ends before a run of spaces, and between two characters that no piece
    holds side by side.  The parts of words met before are kept, up to a bound.
    """
    find = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def parts(w: str) -> list[bytes]:
        ends = [i for i in range(1, len(w)) if w[i - 1:i + 1] not in pairs]
        return [w[a:b].encode() for a, b in zip([0, *ends], [*ends, len(w)])]

    def cut(text: str) -> list[bytes]:
        if not text:
            return []
        if len(_PARTS) > 300_000:
            _PARTS.clear()
        out = []
        for w in find(SPACE + text.replace(" ", SPACE)):
            got = _PARTS.get(w)
            if got is None:
                got = parts(w)
                if len(w) <= 64:
                    _PARTS[w] = got
            out += got
        return out

    return cut


HELD_WORDS = 400_000                       # distinct words of a task before it numbers them anew
WINDOW = 1024                              # starts of a long word's substrings that are taken from one string


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for; ``new`` lists those not handed on yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


def numbered(rows: DataFrame, cut) -> DataFrame:
    """For rows (k, t): rows (i, w), each new word and its number, before rows (k, parts), the texts that hold it.

    parts: the CRC-32 of the text as it decodes (U+2581 as a space), then the numbers of its words.
    Numbers count from 0 in each task, and again after HELD_WORDS words.
    """
    k = rows.schema["k"].dataType
    schema = f"i int, w string, k {k.simpleString()}, parts binary"

    def task(batches):
        held = _Numbers()
        for batch in batches:
            if len(held) > HELD_WORDS:
                held = _Numbers()
            first, parts = len(held), []
            for t in batch.column("t"):
                t = t.as_py()
                at = np.fromiter(map(held.__getitem__, cut(t)), np.int32)
                parts.append(zlib.crc32(t.replace(SPACE, " ").encode()).to_bytes(4, "little") + at.tobytes())
            keys, n = batch.column("k"), len(held.new)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(first, first + n), pa.int32()), pa.array(held.new, pa.binary()).cast(pa.string()),
                pa.nulls(n, keys.type), pa.nulls(n, pa.binary())], ["i", "w", "k", "parts"])
            held.new = []
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), keys, pa.array(parts, pa.binary())],
                ["i", "w", "k", "parts"])

    return rows.select("k", "t").mapInArrow(task, schema)


def lattice(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (i, s, size, id, cost, piece): all pieces of each word, and its characters without a piece (id null).

    ``rows``: as ``numbered`` gives them; texts pass by.  The join is to a broadcast table, so rows keep their
    order.  Long words are first cut into overlapping windows, as a substring takes time by its distance
    from the start of its string.
    """
    pieces = F.broadcast(model.table(rows.sparkSession))
    n = F.length("w")                                      # null for texts, as is what becomes of it (least passes nulls over)
    within = lambda most, left: F.when(left.isNotNull(), F.least(F.lit(most), left))
    out = rows.select("*", F.explode_outer(F.sequence(F.lit(0), n - 1, F.lit(WINDOW))).alias("a"))
    out = out.select("i", "k", "parts", "a", within(WINDOW, n - F.col("a")).alias("starts"),
                     F.substring("w", F.col("a") + 1, F.lit(WINDOW + model.longest - 1)).alias("w"))
    out = out.select("i", "k", "parts", "a", "w", F.explode_outer(F.sequence(F.lit(0), F.col("starts") - 1)).alias("s"))
    out = out.select("i", "k", "parts", "a", "w", "s", F.explode_outer(F.sequence(
        F.lit(1), within(model.longest, n - F.col("s")))).alias("size"))
    out = out.select("i", "k", "parts", (F.col("a") + F.col("s")).alias("s"), "size",
                     F.substring("w", F.col("s") + 1, F.col("size")).alias("piece"))
    out = out.join(pieces, "piece", "left").filter("id IS NOT NULL OR size = 1 OR i IS NULL")
    return out.select("i", "s", "size", "id", "cost", F.when(F.col("id").isNull(), F.col("piece")).alias("piece"),
                      "k", "parts")


def merged(n: int, costs: dict[tuple[int, int], float]) -> list[int]:
    """The token bounds of a word of ``n`` characters whose pieces (start, end) have ``costs``.

    The best piece over two neighbouring parts (leftmost on ties) is merged until none
    is left; a heap holds the candidates, so a word takes O(n log n) steps.
    """
    after, before = list(range(1, n + 2)), list(range(-1, n))      # a part is (i, after[i]); 0: merged away
    heap = [(c, s, e, s + 1) for (s, e), c in costs.items() if e == s + 2]
    heapq.heapify(heap)
    while heap:
        _, s, e, middle = heapq.heappop(heap)
        if after[s] != middle or after[middle] != e:
            continue
        after[s], after[middle] = e, 0
        if e < n:
            before[e] = s
        for a, b, m in ((before[s], e, s), (s, after[e] if e < n else 0, e)):
            if a >= 0 and b and (a, b) in costs:
                heapq.heappush(heap, (costs[a, b], a, b, m))
    bounds = [0]
    while bounds[-1] < n:
        bounds.append(after[bounds[-1]])
    return bounds


def best_path(n: int, costs: dict[tuple[int, int], float]) -> list[int]:
    """The token bounds of the path of least total cost (earliest start on ties)."""
    into = defaultdict(list)
    for (s, e), c in costs.items():
        into[e].append((s, c))
    best = [(0.0, 0)]
    for j in range(1, n + 1):
        best.append(min((best[s][0] + c, s) for s, c in into[j]))
    bounds = [n]
    while bounds[-1]:
        bounds.append(best[bounds[-1]][1])
    return bounds[::-1]


def folded(edges: DataFrame, model: Model) -> DataFrame:
    """Rows (k, ids, text_crc32) for every text of ``numbered`` whose words went through ``lattice``."""
    known, unknown, worst, bpe = model.bytes, model.unknown, model.worst, model.kind == BPE

    def ids_of(bounds, places, ids, chars) -> bytes:
        at, out = {x: i for i, x in enumerate(places)}, []
        for x in zip(bounds, bounds[1:]):
            i = at[x]
            if ids[i] >= 0:
                out.append(ids[i])
            else:
                out += [known.get(b, unknown) for b in chars[i].encode()] if known else [unknown]
        return np.array(out, np.int32).tobytes()

    def task(batches):
        words: list[bytes] = []            # the ids of the words by number
        held: list[pa.RecordBatch] = []    # rows of a word that may go on

        def work():
            t = pa.Table.from_batches(held).combine_chunks()
            number = t["i"].fill_null(-1).to_numpy()
            s, size, ids = (t[x].fill_null(-1).to_numpy() for x in ("s", "size", "id"))
            s, e, ids = s.tolist(), (s + size).tolist(), ids.tolist()
            costs, chars, parts = t["cost"].fill_null(-worst).to_pylist(), t["piece"].to_pylist(), t["parts"]
            starts = np.flatnonzero(np.diff(number, prepend=-2)).tolist()
            rows, out, lens, crcs = [], [], [0], []
            for a, b in zip(starts, [*starts[1:], len(number)]):
                if number[a] >= 0:
                    if number[a] == 0:
                        words.clear()
                    if number[a] != len(words):
                        raise RuntimeError("a task's words have lost their order")
                    places = list(zip(s[a:b], e[a:b]))
                    bounds = (merged if bpe else best_path)(e[b - 1], dict(zip(places, costs[a:b])))
                    words.append(ids_of(bounds, places, ids[a:b], chars[a:b]))
                    continue
                for row in range(a, b):
                    raw = parts[row].as_py()
                    one = b"".join([words[i] for i in np.frombuffer(raw, np.int32, offset=4).tolist()])
                    rows.append(row)
                    out.append(one)
                    lens.append(lens[-1] + len(one) // 4)
                    crcs.append(int.from_bytes(raw[:4], "little"))
            held.clear()
            if rows:
                values = pa.array(np.frombuffer(b"".join(out), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [t["k"].combine_chunks().take(pa.array(rows)),
                     pa.ListArray.from_arrays(pa.array(lens, pa.int32()), values), pa.array(crcs, pa.int64())],
                    ["k", "ids", "text_crc32"])

        for batch in batches:
            number = batch.column("i").fill_null(-1).to_numpy()
            ends = np.flatnonzero(np.diff(number)) + 1
            whole = len(number) if len(number) and number[-1] < 0 else int(ends[-1]) if len(ends) else 0
            if whole:
                held.append(batch.slice(0, whole))
                yield from work()
            if whole < len(number):
                held.append(batch.slice(whole))
        if held:
            yield from work()

    k = edges.schema["k"].dataType.simpleString()
    return edges.mapInArrow(task, f"k {k}, ids array<int>, text_crc32 long")


def word_ids(words: DataFrame, model: Model) -> DataFrame:
    """Rows (word, ids) for words (UTF-8 bytes)."""
    rows = words.select(F.col("word").alias("k"), F.decode("word", "UTF-8").alias("t"))
    return folded(lattice(numbered(rows, lambda t: [t.encode()]), model), model).select(F.col("k").alias("word"), "ids")


def encode(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids, text_crc32) for every document, equal to the library's ids.

    A null or empty text has no ids.  Repeated rows are encoded each; an empty table
    gives no rows.  text_crc32 is that of the text as it decodes (U+2581 as a space).
    Words of a BPE model are merged by a heap, in O(n log n) steps.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    return folded(lattice(numbered(rows, cutter(model.pairs)), model), model).withColumnRenamed("k", key)


def decode(ids: Column, model: Model) -> Column:
    """The text of an array of ids, without the dummy prefix."""
    table = F.split(F.lit(",".join(model.hexes)), ",")       # one constant array
    raw = F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")
    text = F.decode(F.unhex(raw), "UTF-8")
    return F.when(text.startswith(" "), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def encoded_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all documents and decode them again: key, n_tokens, ids, round_trip."""
    prepare(docs.sparkSession)
    model = Model(path)
    rows = encode(docs, model, key, text)
    return rows.select(key, F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.crc32(decode(F.col("ids"), model).cast("binary")) == F.col("text_crc32")).alias("round_trip"))
