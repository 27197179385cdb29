"""F8 boolean full-text search over whole texts.

Plans with the same answer:

* ``match_rows`` — a row predicate on the tokenised text (one pass, no
  shuffle; best for a one-off query);
* ``token_index`` + ``index_search`` — (doc, term) postings as a frame, queried
  by term: required terms are counted per document, excluded terms removed by
  an anti join.  Grouping is by document id, so a very common term never
  lands in one task.  ``operators/text_index`` stores the postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import MIN_TOKEN_LEN, boolean_match, parse_boolean_query, tokens


def match_rows(df: DataFrame, text_col: str, query: str) -> DataFrame:
    return df.where(boolean_match(text_col, query))


def token_index(df: DataFrame, id_col: str, text_col: str, min_len: int = MIN_TOKEN_LEN) -> DataFrame:
    """Postings (id, term): each distinct token of at least ``min_len`` characters of each whole text once."""
    t = df.select(F.col(id_col), F.explode(F.array_distinct(tokens(text_col))).alias("term"))
    return t.where(F.length("term") >= min_len)


def index_search(index: DataFrame, docs: DataFrame, id_col: str, query: str) -> DataFrame:
    """Rows of ``docs`` matching a boolean query, answered from the postings."""
    req, exc, opt = parse_boolean_query(query)
    if not req and not opt:
        return docs.limit(0)   # no positive term: nothing matches
    if req:
        hits = (index.where(F.col("term").isin(*req)).groupBy(id_col)
                .agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(set(req))).select(id_col))
    else:
        hits = index.where(F.col("term").isin(*opt)).select(id_col).distinct()
    out = docs.join(hits, id_col, "left_semi")
    if exc:
        out = out.join(index.where(F.col("term").isin(*exc)).select(id_col), id_col, "left_anti")
    return out
