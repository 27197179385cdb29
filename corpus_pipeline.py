"""Corpus pipeline: quality rules, near-duplicate removal, source mixing, SentencePiece encoding.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents.
A row is told from others by all its columns, not by its doc_id: rows that share an id and
differ in anything else are documents of their own, also rows without an id.  Rows equal in
every column are copies and share each verdict; the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import prepare, stored
from sitelens.llm.jaccard import similar_groups
from sitelens.llm.mixing import mix
from sitelens.llm.quality import quality
from sitelens.llm.queries import PIECES, tokenizer_path
from sitelens.llm.spm import encoded_documents


#: Near duplicates share at least NEAR_PERCENT of their shingles of NEAR_WORDS words (op6 has a contract of its own).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a 64-bit key of all columns, and that column's name."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    parts: list[Column] = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
        parts += [F.to_json(F.struct(c.alias("v"))) if nested else c, c.isNull()]     # a null must leave its mark
    return docs.withColumn(name, F.xxhash64(*parts)), name


def _only(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` (with key ``name``) whose key is among ``rows``, without the key."""
    return docs.join(rows.select(name).distinct(), name, "left_semi").drop(name)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    prepare(spark)
    rows, name = _keyed(docs)
    return _only(rows, quality(rows, key=name).filter("kept"), name).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id (rows without one come last)."""
    prepare(spark)
    rows, name = _keyed(docs)
    groups = similar_groups(rows, key=name, span=NEAR_WORDS, percent=NEAR_PERCENT).select(name, "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(name)))
    firsts = groups.join(rows.select(name, "doc_id").distinct(), name).groupBy("component_id").agg(first.alias("x"))
    kept = rows.join(firsts.select(F.col(f"x.{name}").alias(name)), name, "left_semi")
    return kept.dropDuplicates([name]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights meet the smoothed source, language and topic shares."""
    prepare(spark)
    rows, name = _keyed(docs)
    return _only(rows, mix(rows, key=name).filter("sampled"), name).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document."""
    prepare(spark)
    return encoded_documents(docs, tokenizer_path(PIECES))


STAGES = [("quality_rules", keep_quality), ("jaccard_join", drop_near_duplicates),
          ("source_mixing", mix_sources), ("sentencepiece", encode_pieces)]

#: The robust fit and the raking iterate, so SQL can't give the rows.  Tests compare the near-duplicate stage with a
#: brute-force version; no test runs all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
