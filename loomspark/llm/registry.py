"""The corpus queries ``op1_`` to ``op10_``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import anisotropic, chosen_path, edit_print, langid, licences, packing, pieces, quality, tokenfile, toxicity


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine; on a cluster it lies there on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, from a model fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, 0)


def op3_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_print.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document, from a model fitted on the ratings."""
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, tokenizer_path("piece_bpe_32k.model")))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), "licensed")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.links(table(spark, sf_dir, "documents"), 5, 0.8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_packing, op3_anisotropic_search, op4_edit_fingerprints, op5_quality, op6_language_id, op7_token_file, op8_pieces, op9_licences, op10_ngram_jaccard)
}

#: None of these can be said in SQL: they rest on fitted models, tokenizer files or random walks.  Tests hold them
#: against brute force, library output, round trips or held-out accuracy instead.
ORACLE_SQL: dict[str, str] = {}
