"""Language by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` positions. One recurrent layer reads each
window forwards, one backwards; both states of a position give the probabilities of the languages
there, and a document's probabilities are their mean over all its positions. Every byte of a
text is labelled. The network is trained in numpy by backpropagation through time, on windows
spread evenly over at most ``max_rows`` documents of each language, those whose ids hash lowest.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or if nothing could
be learned from; documents without language are not learned from; of repeated ids the greatest
language and text count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import training
from loomgrid.llm.rows import unwrap, wrap
from loomgrid.llm.wordhash import chunks

MAX_ROWS = 1000
WINDOW = 64
WINDOWS_PER_ROW = 4
UNITS = 8
#: steps of the training, whatever the size of the sample
STEPS = 320
BATCH = 256
RATE = 0.01
UNKNOWN = "und"
#: bytes to label at once
CHUNK = 2048 * WINDOW
WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text or ""))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, n) bytes of all windows, and how many of each are of the text."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    padded = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts))
    filled = np.full(sum(counts), WINDOW)
    for last, t in zip(np.cumsum(counts), texts):
        if t:
            filled[last - 1] = (len(t) - 1) % WINDOW + 1
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW).T, filled


class Reader:
    """One gated recurrent layer. Columns of the weights: update, reset, candidate."""

    def __init__(self, draw: np.random.Generator, units: int = UNITS):
        self.units = units
        self.byte = draw.normal(0, 0.5, (256, 3 * units)).astype(np.float32)
        self.state = draw.normal(0, units**-0.5, (units, 3 * units)).astype(np.float32)
        self.bias = np.zeros(units, np.float32)  # inside the reset of the candidate

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.bias]

    def read(self, symbols: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, units, n) after every step of ``symbols (steps, n)``.

        Windows are the last axis everywhere, so that every operation runs over long rows of memory.
        """
        steps, n = symbols.shape
        u = self.units
        table, turned, bias = self.byte.T.copy(), self.state.T.copy(), self.bias[:, None]
        # the logistic function by tanh of half its input, which numpy computes with vector instructions
        table[: 2 * u] *= 0.5
        turned[: 2 * u] *= 0.5
        states = np.empty((steps, u, n), np.float32)
        h = np.zeros((u, n), np.float32)
        gates, inner = np.empty((3 * u, n), np.float32), np.empty((3 * u, n), np.float32)
        both, past, candidate = gates[: 2 * u], inner[2 * u :], gates[2 * u :]
        z, r = both[:u], both[u:]
        for t in range(steps):
            # every byte is in the table; take() writes to where it is told without a copy only if it need not check
            np.take(table, symbols[t], axis=1, out=gates, mode="clip")
            np.dot(turned, h, out=inner)
            both += inner[: 2 * u]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            past += bias
            if trace is not None:
                kept = h, z.copy(), r.copy(), past.copy()
            past *= r
            candidate += past
            np.tanh(candidate, out=candidate)
            following = states[t]
            np.subtract(h, candidate, out=following)
            following *= z
            following += candidate
            if trace is not None:
                trace.append((*kept, candidate.copy()))
            h = following
        return states

    def back(self, symbols: np.ndarray, trace: list, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights, from the slopes of the loss by every state."""
        u = self.units
        grads = [np.zeros_like(w) for w in self.weights]
        carried = np.zeros_like(slope[0])
        for t in range(len(trace) - 1, -1, -1):
            h, z, r, past, candidate = trace[t]
            d = slope[t] + carried
            dc = d * (1 - z) * (1 - candidate * candidate)
            dz = d * (h - candidate) * z * (1 - z)
            dr = dc * past * r * (1 - r)
            outer = np.concatenate([dz, dr, dc])
            inner = np.concatenate([dz, dr, dc * r])
            for k in range(3 * u):
                grads[0][:, k] += np.bincount(symbols[t], outer[k], 256)
            grads[1] += h @ inner.T
            grads[2] += inner[2 * u :].sum(1)
            carried = d * z + self.state @ inner
        return grads


class Tagger:
    """Both readers, and the probabilities at every position."""

    def __init__(self, languages: list[str]):
        draw = np.random.default_rng(5)
        self.languages = languages
        self.ahead, self.behind = Reader(draw), Reader(draw)
        self.out = draw.normal(0, 0.3, (2 * UNITS, len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights, *self.behind.weights, self.out, self.base]

    def label(self, symbols: np.ndarray, traces: tuple = (None, None)):
        """Probabilities (steps, n, languages), and the states they come from."""
        forward = self.ahead.read(symbols, traces[0])
        backward = self.behind.read(symbols[::-1], traces[1])[::-1]
        z = self.out[:UNITS].T @ forward
        z += self.out[UNITS:].T @ backward
        z += self.base[:, None]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z.swapaxes(1, 2), forward, backward

    def gradients(self, symbols: np.ndarray, filled: np.ndarray, language: np.ndarray):
        """Gradients of the mean cross entropy of all filled positions."""
        traces: tuple = ([], [])
        p, forward, backward = self.label(symbols, traces)
        p[:, np.arange(len(language)), language] -= 1
        p *= (np.arange(len(symbols))[:, None] < filled)[..., None]
        p /= filled.sum()
        slopes = p.swapaxes(1, 2)
        sides = [
            (self.ahead, symbols, traces[0], self.out[:UNITS] @ slopes),
            (self.behind, symbols[::-1], traces[1], (self.out[UNITS:] @ slopes)[::-1]),
        ]
        out = [(s @ p).sum(0) for s in (forward, backward)]
        grads = [g for reader, *rest in sides for g in reader.back(*rest)]
        return [*grads, np.concatenate(out), p.sum((0, 1))]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of every text, over all its bytes; zero for an empty one."""
        symbols, filled = windows(texts)
        totals = np.zeros((len(filled), len(self.languages)))
        for at in range(0, len(filled), CHUNK // WINDOW):
            cut = slice(at, at + CHUNK // WINDOW)
            p, _, _ = self.label(np.ascontiguousarray(symbols[:, cut]))
            short = np.flatnonzero(filled[cut] < WINDOW)
            for i in short:
                p[filled[at + i] :, i] = 0
            totals[cut] = p.sum(0)
        counts = [-(-len(t) // WINDOW) for t in texts]
        of = np.repeat(np.arange(len(texts)), counts)
        sums = np.stack([np.bincount(of, column, len(texts)) for column in totals.T], axis=1)
        return sums / np.maximum([[len(t)] for t in texts], 1)


def train(rows: pd.DataFrame) -> Tagger | None:
    """Network fitted to rows ``lang, windows`` by Adam; None without rows."""
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    number = {x: i for i, x in enumerate(languages)}
    texts = [bytes(w) for ws in rows["windows"] for w in ws]
    language = np.array([number[x] for x, ws in zip(rows["lang"], rows["windows"]) for _ in ws])
    symbols, filled = windows(texts)
    model, draw = Tagger(languages), np.random.default_rng(6)
    means = [np.zeros_like(w) for w in model.weights]
    squares = [np.zeros_like(w) for w in model.weights]
    queue = np.array([], np.int64)
    for done in range(1, STEPS + 1):
        while len(queue) < min(BATCH, len(texts)):
            queue = np.concatenate([queue, draw.permutation(len(texts))])
        pick, queue = queue[:BATCH], queue[BATCH:]
        grads = model.gradients(symbols[:, pick], filled[pick], language[pick])
        size = np.sqrt(sum((g * g).sum() for g in grads))
        rate = RATE * (1.05 - done / STEPS)
        for w, g, m, v in zip(model.weights, grads, means, squares):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
    return model


def spread(text: str) -> list[bytes]:
    """Windows spread evenly over a text, all of a short one."""
    data = text.encode()
    count = min(WINDOWS_PER_ROW, -(-len(data) // WINDOW))
    starts = np.linspace(0, max(0, len(data) - WINDOW), count).astype(int)
    return [data[s : s + WINDOW] for s in starts]


def fit(docs: DataFrame, learned, max_rows: int = MAX_ROWS) -> Tagger | None:
    """Network learned from ``docs (doc_id, text, lang)``, of rows where ``learned`` holds."""
    known = docs.select(F.col("doc_id").alias("id"), "lang").where("id is not null and lang is not null")
    known = known.where(learned).groupBy("id").agg(F.max("lang").alias("lang"))
    rows = training.with_texts(training.by_hash(known, "id", max_rows, "lang"), docs)

    def cut(parts):
        for part in parts:
            part = part[[has_letter(t) for t in part["text"]]] if len(part) else part
            yield pd.DataFrame({"id": part["id"], "lang": part["lang"], "windows": [spread(t) for t in part["text"]]})

    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang string, windows array<binary>"
    return training.fit(rows.mapInPandas(cut, schema), train)


def labeller(spark, model: Tagger | None):
    """Column function: (lang, score) of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [_labels(part, shared.value) for part in chunks(list(texts))]
            yield pd.concat(found) if found else pd.DataFrame({"lang": [], "score": []})

    return label


def _labels(texts: list[str | None], model: Tagger | None) -> pd.DataFrame:
    known = np.array([model is not None and has_letter(t) for t in texts], bool)
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if known.any():
        pooled = model.pooled([t.encode() for t, k in zip(texts, known) if k])
        lang[known] = np.array(model.languages, object)[pooled.argmax(1)]
        score[known] = np.minimum(pooled.max(1), 1)
    return pd.DataFrame({"lang": lang, "score": score})


def with_language(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with ``held_out``, ``lang_pred`` and ``score``."""
    rows = wrap(df, doc_id=doc_id, text=text, lang=lang)
    model = fit(rows.select("doc_id", "text", "lang"), training.remainder(F.col("id"), 4) != 2)
    found = rows.withColumn("found", labeller(df.sparkSession, model)(F.col("text")))
    return unwrap(
        found,
        held_out=F.coalesce(training.remainder(F.col("doc_id"), 4) == 2, F.lit(False)),
        lang_pred=F.col("found.lang"),
        score=F.col("found.score"),
    )


def keep_sure(
    df: DataFrame, least: float = 0.3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Rows whose language is known, with a mean probability of ``least`` at least."""
    rows = wrap(df, doc_id=doc_id, text=text, lang=lang).withColumnRenamed("_row", "_doc")
    marked = with_language(rows)
    return marked.where(F.col("lang_pred") != UNKNOWN).where(F.col("score") >= least).select("_doc.*")
