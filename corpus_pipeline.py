"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``documents``. A stage works on every row that its predecessor kept. Defined results for nulls,
empty texts, ties, repeated rows and clashing names are those of the operators it calls.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import language, line_dedup, near_copies, packing, quality
from loomgrid.llm.rows import documents, labels
from loomgrid.session import bound_batches, stage

Step = Callable[[SparkSession, DataFrame, str], DataFrame]
#: a line on over so large a share of its source's distinct texts is boilerplate
LINE_RATIO = 0.02


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality, learned from the labelled and unlabelled ones."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network is sure of; those without letters go as well."""
    return language.keep_sure(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines of their source, their length counted anew.

    Copies are still there, so equal texts of a source count as one page."""
    cleaned = line_dedup.dedup_lines(docs, host="source", ratio=LINE_RATIO, copies_once=True)
    counted = cleaned.withColumn("n_chars", F.length("text").cast("bigint"))
    return counted.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that SimHash links, and copies with changed
    passages, which differ in more bits but share 0.8 of their five-word shingles."""
    return near_copies.keep_one(docs, by_fingerprint=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their place in sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def bounded(step: Step) -> Step:
    """A stage whose Python tasks read whole texts in batches of a few megabytes."""

    @functools.wraps(step)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return step(spark, docs, sf_dir)

    return run_bounded


STAGES: list[tuple[str, Step]] = [
    ("quality_classifier", bounded(quality_stage)),
    ("language_id", bounded(language_stage)),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", bounded(near_duplicate_stage)),
    ("best_fit_packing", bounded(packing_stage)),
]

#: models and fingerprints are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
