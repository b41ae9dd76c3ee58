"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import (
    deleted_interpolation,
    fertility,
    fingerprints,
    language,
    line_dedup,
    merkle,
    packing,
    pieces,
    quality,
    simhash,
    spelling,
    toxicity,
    warc,
)
from loomgrid.llm.rows import documents, labels, pages


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on over a tenth of their source's documents."""
    cleaned = line_dedup.dedup_lines(documents(spark, sf_dir), host="source")
    return cleaned.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all texts, learned from the labels that are not held out."""
    scored = toxicity.with_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all texts, learned from good and unlabelled ones that are not held out."""
    scored = quality.with_quality(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, written as archives and read back."""
    return warc.archive_and_read(pages(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all texts and of their edited forms, with likenesses."""
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences of at most 1024 ids."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, figures of two public vocabularies and the verdict for all texts."""
    judged = fertility.judge(
        documents(spark, sf_dir).select("doc_id", "text", "lang"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return judged.drop("lang")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all texts, learned from documents that are not held out."""
    labelled = language.with_language(documents(spark, sf_dir))
    return labelled.select("doc_id", "held_out", "lang_pred", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all texts, what they decode to, and where the pieces end in the text."""
    encoded = pieces.with_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all texts and the components of their near-duplicate links."""
    return simhash.component_table(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and roots of all documents, with tampered rows that do not verify."""
    return merkle.document_manifest(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all texts with their near words, forms and roots."""
    return spelling.variants(documents(spark, sf_dir))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a bigram model of those that are not held out, and by single tokens."""
    return deleted_interpolation.document_scores(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_toxicity,
        op3_quality,
        op4_warc,
        op5_fingerprints,
        op6_best_fit_packing,
        op7_fertility_rules,
        op8_language,
        op9_sentencepiece,
        op10_simhash_near_dedup,
        op11_merkle_manifest,
        op12_spelling_variants,
        op13_lm_scores,
    )
}
