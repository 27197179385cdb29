"""Queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.common import prepare

BYTE_BPE, BYTE_BPE_VOCABULARY, END_ID = "byte_bpe_50k.json", 50_257, 2
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.spm import encoded_documents
    return encoded_documents(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.tokenbin import token_files
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), END_ID, BYTE_BPE_VOCABULARY)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.chat import chat_digests
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    digests = chat_digests(turns.unionByName(extra), tokenizer_path(BYTE_BPE), BYTE_BPE_VOCABULARY)
    return digests.drop("n_tokens", "loss_tokens")         # the SQL check has no tokenizer


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.fingerprint import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.quality import quality
    return quality(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.jaccard import similar_groups
    return similar_groups(table(spark, sf_dir, "documents"))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.warc import archive_pages
    return archive_pages(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.license import scan
    return scan(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.hmm import score
    return score(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.langid import identify
    return identify(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.runs import run_digests
    return run_digests(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.divergence import audit
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_token_files, op3_chat_format, op4_fingerprints, op5_quality_rules, op6_jaccard_join, op7_warc_archive, op8_license_scan,
    op9_source_mixing, op10_lm_scoring, op11_language_id, op12_periodic_runs, op13_source_divergence)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE = {
    "op3_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                LENGTH(REPLACE(REPLACE(REPLACE(REPLACE(role || chr(1) || text, '\', '\\'), '<turn>', '<\turn>'),
                       '<says>', '<\says>'), '</turn>', '<\/turn>')) - 1 AS shown FROM t)
        SELECT conv_id, COUNT(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               CAST(SUM(CASE WHEN role = 'assistant' THEN LENGTH(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
               CAST(SUM(shown + 19) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op7_warc_archive": """
        WITH p AS (SELECT page_id, url, encode(COALESCE(html, '')) AS body FROM pages),
        d AS (SELECT page_id, url, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
               COALESCE(url, '') AS target_uri
        FROM f""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, row_number() OVER () AS r,
                     regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
        g AS (SELECT DISTINCT lang, source FROM d),
        k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING COUNT(DISTINCT r) >= 10),
        v AS (SELECT l.lang, COUNT(k.term) AS kept FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN k ON k.lang = l.lang GROUP BY l.lang),
        c AS (SELECT lang, source, term, COUNT(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        n AS (SELECT g.lang, g.source, COALESCE(SUM(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
        p AS (SELECT n.lang, n.source, k.term, COALESCE(c.n, 0) AS n,
                1 + 1000000000::HUGEINT * (COALESCE(c.n, 0) + 2) // (n.n + 2 * v.kept) AS p
              FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (SUM(p.n) + 2) // (ln.n + 2 * v.kept) AS q
              FROM p JOIN (SELECT lang, SUM(n) AS n FROM n GROUP BY lang) ln USING (lang) JOIN v USING (lang)
              GROUP BY lang, term, ln.n, v.kept),
        f AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(f.value, 0) AS value
              FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
                LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL
              SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q)
              FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM r WHERE part = 'pair' OR rank <= 10""",
}
