"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, of neighbouring words and of words
with one or two words between them, in 2 ** 20 slots. Every coordinate has its own learning rate
and an L1 penalty, which leaves a small sparse weight vector; it goes to the executors as a
broadcast of at most 2 ** 20 pairs of slot and weight. Fitted on at most ``max_rows`` labelled
rows of each class (those whose ids hash lowest); every text is scored whole.

Defined results: null and blank texts get the score of the bias alone; labels that are null or
belong to no document are not learned from, of repeated labels the greater one counts; without
both classes every score is the share of label 1, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import training
from loomgrid.llm.rows import unwrap, wrap
from loomgrid.llm.wordhash import Words, chunks, find_words, mixed

SLOT_BITS = 20
MAX_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
#: a row of the rarer class counts as so many at most
MOST_WEIGHT = 4.0
#: distance of the second word, and a multiplier that sets the kinds of feature apart
PAIRS = ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F), (3, 0xA0761D6478BD642F))


def slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and slot of every feature occurrence."""
    docs, found = [words.doc], [words.hash]
    for step, by in PAIRS:
        same = words.doc[step:] == words.doc[:-step]
        first, second = words.hash[:-step][same], words.hash[step:][same]
        docs.append(words.doc[:-step][same])
        found.append(mixed(first * np.uint64(by) + second))
    at = np.concatenate(found) >> np.uint64(64 - SLOT_BITS)
    return np.concatenate(docs), at.astype(np.int64)


def distinct_slots(texts: list[str | None]) -> Iterator[np.ndarray]:
    for part in chunks(texts):
        doc, slot = slots(find_words(part))
        keys = np.unique(doc << SLOT_BITS | slot)
        yield from np.split(
            (keys & (2**SLOT_BITS - 1)).astype(np.int32),
            np.searchsorted(keys >> SLOT_BITS, np.arange(1, len(part))),
        )


class Ftrl:
    """Logistic regression with per-coordinate rates; slot 2 ** SLOT_BITS is the bias."""

    def __init__(self):
        self.z = np.zeros(2**SLOT_BITS + 1)
        self.n = np.zeros(2**SLOT_BITS + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.maximum(np.abs(z) - L1, 0) * -np.sign(z)
        return shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights that are not zero, and the bias."""
    none = np.array([], np.int64), np.array([], np.float32)
    if not len(rows) or rows["label"].nunique() < 2:
        share = float(rows["label"].mean()) if len(rows) else 0.0
        return *none, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    model, order = Ftrl(), np.random.default_rng(7)
    labels = rows["label"].to_numpy()
    bias = np.array([2**SLOT_BITS])
    features = [np.concatenate([np.asarray(f, np.int64), bias]) for f in rows["slots"]]
    counts = np.bincount(labels, minlength=2)
    weight = np.minimum(counts.max() / counts, MOST_WEIGHT)
    for _ in range(EPOCHS):
        for i in order.permutation(len(features)):
            model.learn(features[i], labels[i], weight[labels[i]])
    weights = model.weights()
    at = np.flatnonzero(weights[:-1])
    return at, weights[at].astype(np.float32), float(weights[-1])


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(id, label, text) of at most ``max_rows`` labelled documents of each class, none of
    them held out."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where("id is not null and label is not null")
    known = known.where(training.remainder(F.col("id"), 5) != 0)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    sides = [training.by_hash(known.where(F.col("label") == y), "id", max_rows) for y in (0, 1)]
    return training.with_texts(sides[0].union(sides[1]), docs)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS):
    """Weights learned from ``labels (doc_id, label)`` of ``docs (doc_id, text)``."""

    def features(batches):
        for rows in batches:
            found = [s.tolist() for s in distinct_slots(list(rows["text"]))]
            yield pd.DataFrame({"id": rows["id"], "label": rows["label"], "slots": found})

    rows = sample(docs, labels, label, max_rows)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label int, slots array<int>"
    return training.fit(rows.mapInPandas(features, schema), train)


def scorer(spark, model):
    """Column function: toxicity of a text, from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights, bias = shared.value
        table = np.zeros(2**SLOT_BITS, np.float32)
        table[at] = weights
        for texts in batches:
            sums = [_sums(find_words(part), table) for part in chunks(list(texts))]
            total = np.concatenate(sums) if sums else np.array([])
            yield pd.Series(1 / (1 + np.exp(-np.clip(total + bias, -30, 30))))

    return score


def _sums(words: Words, table: np.ndarray) -> np.ndarray:
    doc, slot = slots(words)
    told = np.flatnonzero(table[slot])
    keys = np.unique(doc[told] << SLOT_BITS | slot[told])
    return np.bincount(keys >> SLOT_BITS, table[keys & (2**SLOT_BITS - 1)], words.n_docs)


def with_toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``held_out``, ``score`` and ``predicted``."""
    rows = wrap(df, doc_id=doc_id, text=text)
    model = fit(rows.select("doc_id", "text"), labels)
    score = scorer(df.sparkSession, model)
    rows = rows.withColumn("score", score(F.col("text")))
    return unwrap(
        rows,
        held_out=F.coalesce(training.remainder(F.col("doc_id"), 5) == 0, F.lit(False)),
        score="score",
        predicted=(F.col("score") >= 0.5).cast("int"),
    )
