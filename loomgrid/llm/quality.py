"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled 1; labels of 0 are never used. Unlabelled web text is a
sample of all documents, good and bad mixed. A first network tells positives from unlabelled
text; on the half of both that it has not seen, the class prior is the least ratio of the two
shares above a threshold, since the best scores of the unlabelled text are all good. A second
network then minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

where a mini-batch whose second part is negative takes a step back on that part instead. Inputs
are figures of form (shares of kinds of characters, repetition of words, word pairs and lines,
lengths), computed over the whole text; so the model is small and the same for all languages.

Fitted on at most ``max_rows`` positives and as many unlabelled rows, those whose ids hash lowest.

Defined results: a null or blank text is scored by its figures, all zero; labels that are null or
belong to no document are not learned from; without positives every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import training
from loomgrid.llm.rows import unwrap, wrap
from loomgrid.llm.wordhash import LOWER, Words, chunks, find_words, range_hash

MAX_ROWS = 6000
HIDDEN = 24
EPOCHS = 30
BATCH = 256
RATE = 0.01
THRESHOLD = 0.3
#: characters whose shares of a text are told apart
KINDS = ("!", "?", ".", ",", "|", "*", "#", "$", "%", "&", "@", "/", "<>{}[]()=_\\^~`", "-:;'\"", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\n", " \t\r")
KIND = np.full(256, len(KINDS), np.int64)
for _number, _characters in enumerate(KINDS):
    KIND[[ord(c) for c in _characters]] = _number
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def repeats(doc: np.ndarray, key: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of a document's entries that are equal to an earlier one of it."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    again = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    total = np.bincount(doc, minlength=n_docs)
    return np.bincount(d[1:][again], minlength=n_docs) / np.maximum(total, 1)


def figures(words: Words) -> np.ndarray:
    """One row of figures per document."""
    n = words.n_docs
    size = np.maximum(np.diff(words.doc_start) - 1, 0)
    of = np.repeat(np.arange(n), np.diff(words.doc_start))
    kinds = np.bincount(of * (len(KINDS) + 1) + KIND[words.raw], minlength=n * (len(KINDS) + 1))
    kinds = kinds.reshape(n, -1)[:, : len(KINDS)].astype(float)
    kinds[:, KINDS.index("\n")] -= 1  # the one that ends the text
    shares = np.sqrt(np.maximum(kinds, 0) / np.maximum(size, 1)[:, None])
    count = np.bincount(words.doc, minlength=n)
    some = np.maximum(count, 1)
    length = words.end - words.start
    # bytes beyond ASCII take part in a word as two or three bytes each
    mean = np.bincount(words.doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(words.doc, length.astype(float) ** 2, n) / some - mean**2, 0))
    follows = words.doc[1:] == words.doc[:-1]
    same = follows & (words.hash[1:] == words.hash[:-1])
    twice = np.bincount(words.doc[1:][same], minlength=n) / some
    pairs = (words.hash[:-1] * np.uint64(3) + words.hash[1:])[follows]
    breaks = np.flatnonzero(words.raw == 10)
    line_start, line_doc = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks, of[breaks]
    lines = range_hash(LOWER[words.raw], line_start, breaks)
    filled = breaks > line_start
    upper_first = np.bincount(words.doc, (KIND[words.raw[words.start]] == KINDS.index(KINDS[15])), n) / some
    return np.column_stack(
        [
            shares,
            np.log1p(count) / 8,
            mean / 10,
            spread / 10,
            twice,
            repeats(words.doc, words.hash, n) * np.minimum(1, 200 / some),
            repeats(words.doc[:-1][follows], pairs, n),
            repeats(line_doc[filled], lines[filled], n),
            np.log1p(np.bincount(line_doc, filled, n)) / 5,
            upper_first,
            count == 0,
        ]
    )


class Net:
    """One hidden layer of tanh units, trained by Adam."""

    def __init__(self, inputs: int, seed: int):
        draw = np.random.default_rng(seed)
        self.p = [draw.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v = [0 * p for p in self.p], [0 * p for p in self.p]
        self.t = 0

    def hidden(self, x):
        return np.tanh(x @ self.p[0] + self.p[1])

    def logit(self, x):
        return self.hidden(x) @ self.p[2] + self.p[3]

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        """A step down, given the slope of the loss by every row's logit."""
        h = self.hidden(x)
        back = np.outer(slope, self.p[2]) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ slope, slope.sum(keepdims=True)]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            ahead = self.m[i] / (1 - 0.9**self.t)
            self.p[i] = self.p[i] - RATE * ahead / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def batches(n_p: int, n_u: int, draw) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both kinds, each once per epoch, in batches of the same proportions."""
    count = max(1, (n_p + n_u) // BATCH)
    yield from zip(np.array_split(draw.permutation(n_p), count), np.array_split(draw.permutation(n_u), count))


def told_apart(pos: np.ndarray, web: np.ndarray) -> Net:
    """Network that tells positives from unlabelled rows, both weighing the same."""
    net, draw = Net(pos.shape[1], 1), np.random.default_rng(2)
    for _ in range(EPOCHS):
        for p, u in batches(len(pos), len(web), draw):
            if len(p) and len(u):
                x = np.vstack([pos[p], web[u]])
                z = sigmoid(net.logit(x))
                slope = np.concatenate([(z[: len(p)] - 1) / len(p), z[len(p) :] / len(u)])
                net.step(x, slope)
    return net


def class_prior(pos: np.ndarray, web: np.ndarray) -> float:
    """Share of positives in unlabelled text, from scores of rows of both kinds: the least upper
    bound over all thresholds, with the deviations that samples of these sizes may show."""
    cuts = np.unique(pos)
    share_p = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    share_u = 1 - np.searchsorted(np.sort(web), cuts) / len(web)
    doubt = np.sqrt(np.log(40) / 2) * (len(pos) ** -0.5 + len(web) ** -0.5)
    best = np.argmin((share_u + doubt) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.98))


def non_negative(pos: np.ndarray, web: np.ndarray, prior: float) -> Net:
    """Network of least non-negative risk under the logistic loss."""
    net, draw = Net(pos.shape[1], 3), np.random.default_rng(4)
    for _ in range(EPOCHS):
        for p, u in batches(len(pos), len(web), draw):
            if not len(p) or not len(u):
                continue
            x = np.vstack([pos[p], web[u]])
            z = net.logit(x)
            s, n = sigmoid(z), len(p)
            rest = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
            # slopes of R+ on positives, and of R- on both
            good = np.concatenate([prior * (s[:n] - 1) / n, np.zeros(len(u))])
            bad = np.concatenate([-prior * s[:n] / n, s[n:] / len(u)])
            net.step(x, good + bad if rest >= 0 else -bad)
    return net


def train(rows: pd.DataFrame) -> tuple | None:
    """(mean, scale, parameters, prior) of rows ``positive, figures``; None without positives."""
    if not len(rows) or not rows["positive"].any() or rows["positive"].all():
        return None
    x = np.stack([np.asarray(f, float) for f in rows["figures"]])
    is_pos = rows["positive"].to_numpy().astype(bool)
    web = x[~is_pos]
    mean, scale = web.mean(0), web.std(0) + 0.02
    x = np.clip((x - mean) / scale, -6, 6)
    pos, web = x[is_pos], x[~is_pos]
    first = told_apart(pos[::2], web[::2])
    prior = class_prior(first.logit(pos[1::2]), first.logit(web[1::2])) if len(pos) > 1 < len(web) else 0.5
    return mean, scale, non_negative(pos, web, prior).p, prior


def scores(words: Words, model: tuple | None) -> np.ndarray:
    if model is None:
        return np.full(words.n_docs, 0.5)
    mean, scale, p, _ = model
    x = np.clip((figures(words) - mean) / scale, -6, 6)
    return sigmoid(np.tanh(x @ p[0] + p[1]) @ p[2] + p[3])


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(id, positive, text) of positives and of unlabelled text, none of them held out."""
    learned = training.remainder(F.col("id"), 5) != 0
    known = labels.where(F.col(label) == 1).select(F.col("doc_id").alias("id"))
    known = training.by_hash(known.where("id is not null").where(learned).distinct(), "id", max_rows)
    web = docs.select(F.col("doc_id").alias("id")).where("id is not null").where(learned)
    web = training.by_hash(web.distinct(), "id", max_rows)
    rows = known.select("id", F.lit(True).alias("positive"))
    return training.with_texts(rows.union(web.select("id", F.lit(False))), docs)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS):
    def measured(parts):
        for rows in parts:
            found = [figures(find_words(part)) for part in chunks(list(rows["text"]))]
            found = np.vstack(found).tolist() if found else []
            yield pd.DataFrame({"id": rows["id"], "positive": rows["positive"], "figures": found})

    rows = sample(docs, labels, label, max_rows)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, positive boolean, figures array<double>"
    return training.fit(rows.mapInPandas(measured, schema), train)


def scorer(spark, model):
    """Column function: quality of a text, from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = [scores(find_words(part), shared.value) for part in chunks(list(texts))]
        return pd.Series(np.concatenate(found) if found else [], dtype="float64")

    return score


def with_quality(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``held_out``, ``score`` and ``predicted``."""
    rows = wrap(df, doc_id=doc_id, text=text)
    score = scorer(df.sparkSession, fit(rows.select("doc_id", "text"), labels))
    rows = rows.withColumn("score", score(F.col("text")))
    return unwrap(
        rows,
        held_out=F.coalesce(training.remainder(F.col("doc_id"), 5) == 0, F.lit(False)),
        score="score",
        predicted=(F.col("score") >= THRESHOLD).cast("int"),
    )


def keep_good(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose text is predicted to be of quality."""
    marked = with_quality(wrap(df, doc_id=doc_id, text=text).withColumnRenamed("_row", "_doc"), labels, "doc_id", "text")
    return marked.where("predicted = 1").select("_doc.*")
