"""Queries of the training-data operators and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm import (ann, chat, divergence, line_dedup, packing, quality_classifier, quality_rules, sentencepiece_codec,
                           sharding, simhash, token_file, warc, whitening)
from merchlens.llm.common import table
from merchlens.llm.tokens import vocabulary_path
from merchlens.session import materialize, scratch_dir


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the later occurrences of repeated three-line windows removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as a content-addressed archive, read it back."""
    path = scratch_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path).select(
        "page_id", "header", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"))
    return warc.record_fields(back, "page_id", "payload_bytes", "payload_digest").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into a grammar-compressed id file, read it back."""
    path = scratch_dir(spark, "token-file")
    docs = table(spark, sf_dir, "documents")
    token_file.write_file(docs, path, vocabulary_path("word_bpe_49k.json"), end_id=1)
    return token_file.read_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations (and one of control strings) as chats, read them back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = materialize(chat.linear(rows.unionByName(tricky)), "chat-messages")
    formatted = materialize(chat.format_paths(messages, chat.best_paths(messages)), "chat-formatted")
    return chat.digests(formatted, "conv_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into pieces and decode them again."""
    path = vocabulary_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", sentencepiece_codec.encode_column(F.col("text"), path).alias("ids"))
    text = sentencepiece_codec.decode_column(F.col("ids"), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        text.alias("text")).select(
        "doc_id", "n_ids", "ids_crc32", F.length("text").cast("long").alias("decoded_chars"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = ann.search(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)
    return out.select("query_id", "rank", "vec_id", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and line-first verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality_rules.verdict(F.col("text")).alias("v")).select("doc_id", "v.*")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the eight leading components, whitened."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, and where they would be in 25."""
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_sharding": op12_sharding,
    "op13_source_divergence": op13_source_divergence,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_token_file": op5_token_file,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_nearest_neighbours": op9_nearest_neighbours,
}

_OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN strlen(p.h) >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(p.h) >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON o.h = p.h
"""

# The digests of what went in; the formatted length follows from the template, 32 characters
# a turn and one backslash for each control string's first character.
_OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text) + 32
        + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": _OP6_SQL,
    "op2_line_dedup": line_dedup.LINE_DEDUP_SQL.format(src="documents"),
    "op3_warc": _OP3_SQL,
    "op10_quality_rules": quality_rules.RULES_SQL.format(src="documents", max_lost=quality_rules.MAX_LOST_PERCENT, extra=""),
    "op12_sharding": sharding.SHARDING_SQL.format(src="documents", shards=24),
    "op13_source_divergence": divergence.DIVERGENCE_SQL.format(src="documents", min_docs=divergence.MIN_DOCS, top=divergence.TOP),
}
