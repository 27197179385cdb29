"""F8 at scale: a stored inverted index with document frequencies.

A segment holds the postings of a batch of documents, ``(term, id)`` in files that
are split by term bucket and sorted by term, and the term's document frequency.  A
search opens only the buckets of its words.  Segments are written once; adding
documents writes a new segment, ``compact`` joins all of them into one.  The list of
segments is a table with a snapshot pointer, so a search sees whole segments only.

Postings are dealt out by ranges of (bucket, term, id), not by term: a word that a
third of all documents hold is spread over many tasks and files.

A search starts with the required word of the lowest document frequency.  If at most
``broadcast_ids`` documents hold it - known exactly, from the index - its ids are
broadcast to the postings of the other words, which are then never shuffled; beyond that
bound ids are joined by shuffle.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.text import MIN_TOKEN_LEN, parse_boolean_query
from sitelens.operators.text_search import token_index
from sitelens.sources.snapshots import LostUpdate, SnapshotTable

BROADCAST_IDS = 1_000_000                  # ids of eight bytes: about 16 MB as a hash table's keys


class TextIndex:
    """The index under ``path``; ``id_type`` is the SQL type of the document ids."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint",
                 min_len: int = MIN_TOKEN_LEN, broadcast_ids: int = BROADCAST_IDS):
        self.spark, self.path, self.buckets, self.id_type = spark, path.rstrip("/"), buckets, id_type
        self.min_len, self.broadcast_ids = min_len, broadcast_ids
        self.segments = SnapshotTable(spark, f"{self.path}/segments")

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame) -> str:
        """A segment of rows (term, id), each posting once."""
        name = uuid.uuid4().hex
        tasks = max(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = postings.withColumn("bucket", self._bucket()).repartitionByRange(tasks, "bucket", "term", "id")
        rows.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.path}/postings/{name}")
        counts = self._segment(name).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy(
            "bucket").parquet(f"{self.path}/terms/{name}")
        return name

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"term string, id {self.id_type}, bucket int").parquet(f"{self.path}/postings/{name}")

    def _terms(self, name: str) -> DataFrame:
        return self.spark.read.schema("term string, n bigint, bucket int").parquet(f"{self.path}/terms/{name}")

    def _row(self, name: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(name).alias("name"))

    def names(self) -> list[str]:
        """The published segments, in a fixed order."""
        if self.segments.current() is None:
            return []
        return sorted(r["name"] for r in self.segments.read().collect())

    def add(self, docs: DataFrame, id_col: str, text_col: str, txn: str | None = None) -> None:
        """Index more documents.  With a transaction id, a retried call adds nothing twice."""
        txn = txn or uuid.uuid4().hex
        if any(s.txn == txn for s in self.segments.history()):
            return
        rows = token_index(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", self.min_len)
        name = self._write(rows.where("id IS NOT NULL").distinct())
        if self.segments.current() is None:
            try:
                self.segments.commit(self._row(name), None, txn)
                return
            except LostUpdate:                       # another writer has published the first segment meanwhile
                pass
        self.segments.update(lambda s: s.unionByName(self._row(name)), txn)

    def compact(self) -> None:
        """All segments as one.  Segments that others publish meanwhile stay beside it."""
        old = self.names()
        if len(old) > 1:
            parts = [self._segment(n).select("term", "id") for n in old]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            name = self._write(rows.distinct())
            self.segments.update(lambda s: s.where(~F.col("name").isin(old)).unionByName(self._row(name)))

    def _pick(self, frames: list[DataFrame], words: list[str]) -> DataFrame:
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        hit = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return rows.where(F.col("bucket").isin(hit) & F.col("term").isin(words))

    def postings(self, words: list[str]) -> DataFrame:
        """Rows (term, id) of some words, from their buckets' files alone."""
        return self._pick([self._segment(n) for n in self.names()], words).select("term", "id")

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """How many documents hold each of some words (a document of two segments counts twice)."""
        names = self.names()
        found = {} if not names else {r["term"]: r["n"] for r in self._pick(
            [self._terms(n) for n in names], words).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        return {w: found.get(w, 0) for w in words}

    def search(self, query: str) -> tuple[DataFrame, int]:
        """The ids that match a boolean query, each once, and a bound of their number."""
        req, exc, opt = parse_boolean_query(query, self.min_len)
        words = list(dict.fromkeys(req or opt))
        n = self.frequencies(words) if words else {}
        nothing = self.spark.createDataFrame([], f"id {self.id_type}")
        if not words or not self.names():
            return nothing, 0
        if not req:
            bound = sum(n.values())
            ids = self.postings(words).select("id").distinct()
        else:
            words.sort(key=lambda w: (n[w], w))
            bound = n[words[0]]
            if not bound:
                return nothing, 0
            ids = self.postings(words[:1]).select("id")
            if len(self.names()) > 1:
                ids = ids.distinct()
            for w in words[1:]:
                ids = self._among(ids, bound, w)
        for w in dict.fromkeys(exc):
            bad = self._among(ids, bound, w) if bound <= self.broadcast_ids else self.postings([w]).select("id")
            ids = ids.join(self._side(bad, bound), "id", "left_anti")
        return ids, bound

    def _side(self, ids: DataFrame, bound: int) -> DataFrame:
        return F.broadcast(ids) if bound <= self.broadcast_ids else ids

    def _among(self, ids: DataFrame, bound: int, word: str) -> DataFrame:
        """The ids of ``ids`` whose document holds ``word``; the word's postings are the side that isn't moved."""
        held = self.postings([word]).select("id")
        if bound <= self.broadcast_ids:
            found = held.join(F.broadcast(ids), "id", "left_semi")
            return found.distinct() if len(self.names()) > 1 else found
        return ids.join(held, "id", "left_semi")

    def rows(self, docs: DataFrame, id_col: str, query: str) -> DataFrame:
        """Rows of ``docs`` whose id matches."""
        ids, bound = self.search(query)
        return docs.join(self._side(ids.withColumnRenamed("id", "__hit"), bound), F.col(id_col) == F.col("__hit"), "left_semi")
