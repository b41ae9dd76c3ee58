"""Bounded training samples, and fitting on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import stage


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def by_hash(rows: DataFrame, key: str, limit: int, group: str | None = None) -> DataFrame:
    """At most ``limit`` rows, or so many of each group: those whose keys hash lowest, the same
    ones on every run.

    Rows are counted first, and a bound on the hash lets about four times as many pass as can be
    chosen. So what meets in one task to be ranked does not grow with the table or its tasks.
    """
    by = [group] if group else []
    sizes = stage(rows.groupBy(*by).agg(F.count("*").alias("_rows")), "sizes")
    share = F.least(F.lit(1.0), F.lit(4.0 * limit + 1000) / F.greatest(F.col("_rows"), F.lit(1)))
    hashed = F.xxhash64(key)
    if group:
        first = F.row_number().over(Window.partitionBy(group).orderBy(hashed, key))
        rows = rows.join(sizes, group).where(hashed <= share * 2.0**64 - 2.0**63)
        ranked = rows.drop("_rows").withColumn("_rank", first)
        return ranked.where(F.col("_rank") <= limit).drop("_rank")
    bound = sizes.select(share.alias("share")).first()["share"]
    passed = F.lit(True) if bound is None else hashed <= F.lit(bound * 2.0**64 - 2.0**63)
    return rows.where(passed).orderBy(hashed, key).limit(limit)


def with_texts(sample: DataFrame, docs: DataFrame) -> DataFrame:
    """Sampled (id, ...) rows with the text of their document, one row per id.

    The sample is written first: its size is bounded by the sample's parameter, and Spark
    broadcasts it on the size it reads, so the documents are not shuffled.
    """
    sample = stage(sample, "sample")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(sample, "id")
    return texts.groupBy("id", *[c for c in sample.columns if c != "id"]).agg(F.max("text").alias("text"))


def fit(rows: DataFrame, train: Callable[[pd.DataFrame], object]) -> object:
    """What ``train`` makes of all ``rows`` (a bounded sample), in one task, as a Python object.

    Rows come sorted by id, so the result does not depend on how they were spread.
    """

    def run(batches):
        parts = list(batches)
        data = pd.concat(parts) if parts else pd.DataFrame()
        if len(data):
            data = data.sort_values("id").reset_index(drop=True)
        yield pd.DataFrame({"model": [pickle.dumps(train(data))]})

    model = rows.repartition(1).mapInPandas(run, "model binary").first()["model"]
    return pickle.loads(bytes(model))
