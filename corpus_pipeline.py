"""A corpus pipeline of four stages: language, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
leave out others, whatever their names. Stages work on whole texts of any length, give an empty table for an empty one,
and treat repeated rows alike: those of one doc_id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from periodica.llm import langid, minhash, packing, quality
from periodica.llm.common import table, write_stage
from periodica.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be determined, with the predicted language where `lang` is null; the model learns from the labelled input.

    A text goes if it is null or has no letter, or if no language has half of its words. Where no row is labelled, texts
    with letters stay as they are. Rows with a null doc_id are judged like others.
    """
    model = langid.fit_on(docs.select("doc_id", "text", "lang"))
    return langid.keep_determined(docs.select(*COLUMNS), model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cascade; null and empty texts go, rows with a null doc_id are judged like others."""
    return quality.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates (five-word shingles, similarity 0.8).

    Null texts and those without words stay; rows with a null doc_id go, as nothing can refer to them.
    """
    kept = minhash.near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id")
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens; a null text is empty, rows with a null doc_id go."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), size=2048, end_id=0)


STAGES = [("language_id", language), ("quality_rules", quality_stage), ("minhash_dedup", near_duplicates), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table `documents` of sf_dir; each stage but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_stage(docs, f"pipeline-{name}")
    return docs


#: SQL can't express learned language labels and bin packing; the tests hold each stage against a brute-force version.
ORACLE_SQL = None
