"""One query per operator of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_texts

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", path, tokens=1024)


def packing_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on instruction data: each turn of `conversations` is an example, and what
    assistants say bears loss, so that tokens, segments and loss all limit a sequence."""
    from tessera.llm.packing import pack_turns

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations")
    turns = turns.select(F.struct("conv_id", "turn").alias("at"), F.array(F.struct("role", "text")).alias("turns"))
    out = pack_turns(turns, "at", "turns", path, tokens=1024, segments=16, loss=512)
    return out.select("at.*", *[c for c in out.columns if c != "at"])


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pieces import digest_pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    return digest_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secret import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source is the host) and pages, one row each."""
    from tessera.llm.language import identify_documents, identify_pages, train

    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("long")
    model = train(docs, "doc_id", "text", "lang")
    a = identify_documents(docs, model=model).select("doc_id", none.alias("page_id"), "declared", "identified", "confidence", "accepted")
    b = identify_pages(table(spark, sf_dir, "pages"), model)
    b = b.select(none.alias("doc_id"), "page_id", "declared", "identified", "confidence", "accepted")
    return a.unionByName(b)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_and_index

    merged = archive_and_index(table(spark, sf_dir, "pages"))
    return merged.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lines import drop_similar_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return drop_similar_lines(docs).select("doc_id", "n_lines", "n_dropped", kept)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymise(docs, secret="a key that production takes from its vault")
    return found.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_found"))


QUERIES = {
    "op7_lines": op7_lines,
    "op8_pii": op8_pii,
    "op5_jaccard": op5_jaccard,
    "op2_warc": op2_warc,
    "op6_language": op6_language,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op1_packing": op1_packing,
    "op10_sentencepiece": op10_sentencepiece,
    "packing_turns": packing_turns,
}
ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op9_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
ORACLE_SQL["op2_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
q AS (
  SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last,
    regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)', ['host', 'port', 'rest']) AS m
  FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to,
  CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://')
    THEN array_to_string(list_reverse(string_split(regexp_replace(lower(m.host), '^www\d*\.', ''), '.')), ',') || m.port || ')'
      || CASE WHEN m.rest = '' THEN '/' ELSE lower(m.rest) END
    ELSE u END AS urlkey,
  strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM q
"""
