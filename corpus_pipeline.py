"""The corpus pipeline: four stages, each on all that its predecessor kept, each written and read again.

All stages take any further columns, of whatever name, and give them back (the last gives pieces instead); a null
doc_id stays null; repeated rows are judged alike; an empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import chosen_path, common, langid, packing, quality
from loomspark.llm.registry import table, tokenizer_path
from loomspark.session import ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; null and empty texts, those without a letter and those without a clear
    language go.  Where ``docs`` has no labelled language, all texts with a letter stay."""
    return langid.keep(ship_package(spark) and docs, langid.train(docs, tokenizer_path("piece_bpe_32k.model")))


def usable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are more likely usable than poor, by a model fitted on the ratings; null and empty texts are
    texts without words.  Without ratings of two grades everything stays."""
    return quality.keep(ship_package(spark) and docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the smallest doc_id (null last), of repeated rows one; texts
    without a word are no duplicates."""
    return chosen_path.keep_firsts(ship_package(spark) and docs, 5, 0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 1024 ids; null and empty texts are the end id alone."""
    return packing.pack(ship_package(spark) and docs, tokenizer_path("byte_bpe_50k.json"), 1024, 0)


STAGES = [("language_id", known_language), ("quality", usable), ("ngram_jaccard", one_of_each_group), ("packing", packed)]

#: Models, sketches and tokenizer files: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), spark, name)
    return docs
