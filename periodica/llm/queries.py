"""The thin queries over the corpus operators: each derives its digest columns from an operator's full output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm import bpe, langid, lm, packing, quality, tokenfile, urlfilter, vectors, warc
from periodica.llm.common import crc_fold, table
from periodica.llm.minhash import near_duplicates
from periodica.llm.oracles import oracle_sql


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urlfilter.train(urlfilter.labelled_urls(spark))
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the package that holds them is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), size=2048, end_id=0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.roundtrip(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), vocabulary=50_257, end_id=0)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), crc_fold("doc_id", 7) != 2)
    return found.select("doc_id", (crc_fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_on(docs.where(crc_fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.roundtrip(spark, table(spark, sf_dir, "pages"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_packing": op2_packing,
        "op3_bpe": op3_bpe,
        "op4_token_files": op4_token_files,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_vector_dedup": op8_vector_dedup,
        "op9_language_id": op9_language_id,
        "op10_warc": op10_warc,
    }


__all__ = ["oracle_sql", "queries"]
