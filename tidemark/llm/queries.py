"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scratch import new_path
from tidemark.llm import archive, chat, decontam, hardneg, katz, langid, licenses, mixing, neardup, quality, tokens, toxicity, yinyang
from tidemark.llm.oracles import ORACLES

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    archive.write_archive(_table(spark, sf_dir, "pages"), path)
    return archive.described(archive.read_archive(spark, path))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.severity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", "severity", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (~langid.held_out(F.col("doc_id"), 10)).alias("train"))
    out, _ = katz.score_texts(docs, keep=False)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_words", "score", "share")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # needed by this query alone

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clustered(_table(spark, sf_dir, "embeddings"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scans(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
