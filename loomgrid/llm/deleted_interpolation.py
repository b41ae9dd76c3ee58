"""Scores of texts by a bigram model with deleted interpolation.

The probability of a token is a mixture of three maximum-likelihood estimates: how often it follows the
token before it, how often it occurs, and one part in ``V + 1`` (``V`` distinct training tokens, and one for
all others). The weights depend on how often the token before occurs (half octaves of its count). They are
learned by expectation-maximisation on a part of the training texts, a tenth of them by checksum of
the id, whose counts are deleted from the estimates that have to predict them.

How it spreads. Texts are read once, in chunks of about ``CHUNK_CHARS``; a chunk is written as the numbers of
its tokens and the hashes of its distinct ones. A chunk asks for the counts of its distinct tokens and bigrams
and tells its own: sorted keys in packed arrays, one for each of many ranges of keys. Every range of
keys is added up by one task, which answers each chunk that asked; so a frequent word is one entry per chunk
and no task holds more than a range. Chunk and answers meet again by chunk (``cogroup``), where
the counts of all its tokens are laid out. Weights need a histogram only: of every bucket, how many
deleted tokens have which two likelihood ratios, in eighths of an octave, so what the driver holds is
bounded whatever the corpus. A last pass over the laid out counts adds up the scores; nothing of it shuffles.

Tokens and bigrams are told apart by 64-bit hashes: among a thousand million distinct ones, two share a hash
with a probability of about three per cent.

Defined results: a null or blank text has its end as the only token; a row without id learns and is not held
out; with no training tokens every token is unknown; repeated rows count as often as they occur;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.session import bound_batches, stage

FOLDS = 10
CHUNK_CHARS = 6_000_000
#: tokens that are scored at once
PIECE_TOKENS = 1 << 17
#: entries of a range of keys, at so many entries in all
RANGE_KEYS = 1_000_000
LEAST_RANGES = 8
PER_OCTAVE = 8
CONTEXTS_PER_OCTAVE = 2
ROUNDS = 200
#: tokens that the weights of all buckets count for in each of them
PRIOR = 3.0
ADDED = 0.1
#: no word contains these
END, BEFORE = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" ", b"\n"))
HELD_OUT, DELETED, LEARNED = 0, 1, 2
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, the high ones of which are mostly empty."""
    planes = values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def part_of(doc_id: int | None) -> int:
    """Whether a text is held out, deleted when weights are learned, or just learned from."""
    if doc_id is None:
        return LEARNED
    h = crc32(str(doc_id).encode())
    return HELD_OUT if h % FOLDS == 0 else DELETED if h // FOLDS % FOLDS == 0 else LEARNED


class Numbers(dict):
    """Tokens numbered as they come; the end of a text is 0."""

    def __init__(self):
        super().__init__({b" ": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


CHUNKS = (
    T.StructType()
    .add("chunk", T.LongType())
    .add("ids", T.ArrayType(T.LongType()))
    .add("parts", T.ArrayType(T.ByteType()))
    .add("sizes", T.ArrayType(T.IntegerType()))
    .add("n", T.LongType())
    .add("numbers", T.BinaryType())
    .add("hashes", T.BinaryType())
)


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of batches of (id, text)."""
    ids: list[int | None] = []
    found: list[np.ndarray] = []
    numbers, size = Numbers(), 0

    def emitted() -> pa.RecordBatch:
        digest = xxhash.xxh3_64_intdigest
        row = {
            "chunk": uuid.uuid4().int >> 65,
            "ids": ids,
            "parts": [part_of(i) for i in ids],
            "sizes": [len(x) for x in found],
            "n": sum(map(len, found)),
            "numbers": pack(np.concatenate(found)),
            "hashes": np.array([digest(w) for w in numbers], "<u8").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema(
        [
            ("chunk", pa.int64()),
            ("ids", pa.list_(pa.int64())),
            ("parts", pa.list_(pa.int8())),
            ("sizes", pa.list_(pa.int32())),
            ("n", pa.int64()),
            ("numbers", pa.binary()),
            ("hashes", pa.binary()),
        ]
    )
    for batch in batches:
        for doc_id, text in zip(batch["id"].to_pylist(), batch["text"]):
            text = text.as_py() or ""
            if ids and size + len(text) > CHUNK_CHARS:
                yield emitted()
                ids, found, numbers, size = [], [], Numbers(), 0
            # lower() of bytes changes A-Z only, split() of bytes knows ASCII white space only
            words = text.encode().lower().split()
            codes = np.zeros(len(words) + 1, np.uint32)
            codes[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
            ids.append(doc_id)
            found.append(codes)
            size += len(text)
    if ids:
        yield emitted()


ORDERS = (1, 2)


class Chunk:
    """The tokens of a chunk. What an order needs is made when it is asked for, and not kept."""

    def __init__(self, row):
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.parts = np.asarray(row["parts"], np.int8)
        self.part = np.repeat(self.parts, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.frombuffer(row["hashes"], "<u8")
        self.numbers = unpack(row["numbers"]).astype(np.uint32)

    def order(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and every token's place among them."""
        if kind == 2:
            return distinct(self.pairs())
        keys, place = distinct(self.hashes)
        return keys, place[self.numbers]

    def pairs(self) -> np.ndarray:
        """Hashes of every token with the one before."""
        pairs = self.hashes[self.numbers]
        before = np.roll(pairs, 1)
        before[self.first] = BEFORE
        pairs *= STEP
        before ^= before >> np.uint64(32)
        before *= MIX
        pairs += before
        del before
        pairs ^= pairs >> np.uint64(29)
        pairs *= MIX
        pairs ^= pairs >> np.uint64(32)
        return pairs


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them, with less memory than ``np.unique``."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches as dictionaries, one of them in memory at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def range_bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ends of the ranges of sorted keys; ``ranges`` is a power of two."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    return np.flatnonzero(np.diff(keys >> shift, append=np.uint64(ranges)))


ASKED = "kind int, span int, chunk bigint, keys binary, learned binary, deleted binary"
ANSWERED = "kind int, span int, chunk bigint, learned binary, deleted binary, known bigint"


def asked(chunks: DataFrame, ranges: int) -> DataFrame:
    """What chunks ask and tell: keys of a range, and how often their learned and deleted texts have them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            chunk = Chunk(row)
            for kind in ORDERS:
                keys, place = chunk.order(kind)
                learned = np.bincount(place[chunk.part != HELD_OUT], minlength=len(keys))
                deleted = np.bincount(place[chunk.part == DELETED], minlength=len(keys))
                del place
                told, start = [], 0
                shift = np.uint64(64 - (ranges.bit_length() - 1))
                for last in range_bounds(keys, ranges):
                    cut = slice(start, last + 1)
                    start = last + 1
                    packed = pack_sorted(keys[cut]), pack(learned[cut]), pack(deleted[cut])
                    told.append((kind, int(keys[last] >> shift), row["chunk"], *packed))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told), kinds)], columns)

    columns = ["kind", "span", "chunk", "keys", "learned", "deleted"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return chunks.mapInArrow(ask, ASKED)


def answer(group: pd.DataFrame) -> pd.DataFrame:
    """Of a range of keys, their counts in all chunks for each that asked, and on one of the rows how many
    of them are known."""
    keys = [unpack_sorted(x) for x in group["keys"]]
    ends = np.cumsum([len(x) for x in keys])[:-1]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    found = {}
    for name in ("learned", "deleted"):
        told = np.concatenate([unpack(x) for x in group[name]])
        # sums of counts below 2 ** 53 are exact
        total = np.bincount(place, told.astype(np.float64), len(distinct)).astype(np.uint64)
        found[name] = total
    known = np.zeros(len(group), np.int64)
    known[0] = np.count_nonzero(found["learned"])
    packed = {name: [pack(x) for x in np.split(total[place], ends)] for name, total in found.items()}
    return group[["kind", "span", "chunk"]].assign(**packed, known=known)


def ratio_cell(ratio: np.ndarray) -> np.ndarray:
    """Eighth of an octave of a ratio, far below all others if it is 0."""
    cell = np.full(len(ratio), -9999)
    some = ratio > 0
    cell[some] = np.floor(np.log2(ratio[some]) * PER_OCTAVE)
    return cell


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 of a context that does not occur, else the half octave of its count."""
    bucket = np.zeros(len(count), np.int64)
    some = count > 0
    bucket[some] = 1 + np.floor(np.log2(count[some]) * CONTEXTS_PER_OCTAVE)
    return bucket


def estimates(c1, c2, context, tokens) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of tokens by the one before, and by themselves."""
    by_context = np.divide(c2, context, out=np.zeros(len(c2)), where=context > 0)
    return by_context, c1 / max(tokens, 1)


def contexts(c1: np.ndarray, first: np.ndarray, texts: int) -> np.ndarray:
    """How often the token before occurs; before the first one stands the start of all ``texts``."""
    before = np.roll(c1, 1)
    before[first] = texts
    return before


LAID = T.StructType(
    [
        *(f for f in CHUNKS.fields if f.name in ("ids", "parts", "sizes")),
        T.StructField("c1", T.BinaryType()),
        T.StructField("c2", T.BinaryType()),
        T.StructField(
            "cells",
            T.ArrayType(
                T.StructType()
                .add("bucket", T.IntegerType())
                .add("x", T.IntegerType())
                .add("y", T.IntegerType())
                .add("n", T.LongType())
                .add("log_x", T.DoubleType())
                .add("log_y", T.DoubleType())
            ),
        ),
    ]
)


def laid_out(chunks: DataFrame, answers: DataFrame, totals: dict[str, int]) -> DataFrame:
    """Per chunk the counts of all its tokens and of them with the one before, and the histogram of its
    deleted texts' estimates without their own counts."""

    def lay(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        chunk = Chunk(row)
        packed, left = {}, {}
        answers = answers.sort_values(["kind", "span"])
        cut = chunk.part == DELETED
        for kind in ORDERS:
            _, place = chunk.order(kind)
            own = answers[answers["kind"] == kind]
            learned, deleted = (np.concatenate([unpack(x) for x in own[name]]) for name in ("learned", "deleted"))
            packed[kind] = pack(learned[place])
            # counts below 2 ** 53 are exact
            rest = (learned - deleted).astype(np.float64)
            if kind == 1:
                texts = totals["learned_texts"] - totals["deleted_texts"]
                context = contexts(rest[place], chunk.first, texts)[cut]
            left[kind] = rest[place[cut]]
            del place, learned, deleted, rest
        by_context, alone = estimates(left[1], left[2], context, totals["learned"] - totals["deleted"])
        all_tokens = totals["known"] + 1
        return pd.DataFrame(
            {
                "ids": [row["ids"]],
                "parts": [row["parts"]],
                "sizes": [row["sizes"]],
                "c1": [packed[1]],
                "c2": [packed[2]],
                "cells": [cells(context_bucket(context), by_context * all_tokens, alone * all_tokens)],
            }
        )

    both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInPandas(lay, LAID)


def cells(bucket: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[dict]:
    """Histogram of tokens by bucket and the cells of two ratios, with the sums of their logarithms."""
    table = pd.DataFrame({"bucket": bucket, "x": ratio_cell(x), "y": ratio_cell(y), "n": 1})
    for name, ratio in (("log_x", x), ("log_y", y)):
        table[name] = np.log2(ratio, out=np.zeros(len(ratio)), where=ratio > 0)
    return table.groupby(["bucket", "x", "y"], as_index=False).sum().to_dict("records")


def learned_weights(told: pd.DataFrame) -> np.ndarray:
    """Weights of the three estimates, a row per bucket, by expectation-maximisation on a histogram.

    The weights of all buckets together are learned first; they stand for ``PRIOR`` tokens in each bucket,
    so that every estimate keeps a share, and are those of a bucket without tokens.
    """
    size = int(told["bucket"].max()) + 1 if len(told) else 1
    n = told["n"].to_numpy(np.float64)
    ratios = np.ones((len(told), 3))
    for at, (cell, log) in enumerate((("x", "log_x"), ("y", "log_y"))):
        ratios[:, at] = np.where(told[cell] == -9999, 0.0, np.exp2(told[log] / np.maximum(n, 1)))

    def learn(weights: np.ndarray, bucket: np.ndarray, prior: np.ndarray) -> np.ndarray:
        for _ in range(ROUNDS):
            share = weights[bucket] * ratios
            share *= (n / share.sum(axis=1))[:, None]
            made = prior.copy()
            np.add.at(made, bucket, share)
            made /= made.sum(axis=1, keepdims=True)
            moved = np.abs(made - weights).max()
            weights = made
            if moved < 1e-6:
                break
        return weights

    even = np.full((1, 3), 1 / 3)
    overall = learn(even, np.zeros(len(told), np.int64), even.copy())
    prior = np.repeat(overall * PRIOR, size, axis=0)
    prior[0, 0] = 0  # nothing is known of what follows a token that does not occur
    start = prior / prior.sum(axis=1, keepdims=True)
    return learn(start, told["bucket"].to_numpy(np.int64), prior)


def row_weights(weights: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Weights of every token; contexts beyond the buckets seen take those of the last."""
    return weights[np.minimum(bucket, len(weights) - 1)]


def text_pieces(ends: np.ndarray) -> Iterator[slice]:
    """Runs of whole texts of about ``PIECE_TOKENS`` tokens, a longer text alone, by the ends of all."""
    start = done = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + PIECE_TOKENS, "right")))
        yield slice(start, stop)
        start, done = stop, int(ends[stop - 1])


SCORED = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(laid: DataFrame, weights: np.ndarray, totals: dict[str, int]) -> DataFrame:
    """Scores of the texts of all chunks."""
    names = [x.split()[0] for x in SCORED.split(", ")]
    all_tokens = totals["known"] + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            counts = [unpack(row[c]) for c in ("c1", "c2")]
            ends = np.cumsum(row["sizes"], dtype=np.int64)
            for cut in text_pieces(ends):
                sizes = np.array(row["sizes"][cut], np.int64)
                first = np.cumsum(sizes) - sizes
                at = slice(ends[cut.start] - sizes[0], ends[cut.stop - 1])
                c1, c2 = (x[at].astype(np.float64) for x in counts)
                context = contexts(c1, first, totals["learned_texts"])
                by_context, alone = estimates(c1, c2, context, totals["learned"])
                share = row_weights(weights, context_bucket(context))
                p = share[:, 0] * by_context + share[:, 1] * alone + share[:, 2] / all_tokens
                base = np.log10((c1 + ADDED) / (totals["learned"] + ADDED * all_tokens))
                arrays = [
                    pa.array(row["ids"][cut], pa.int64()),
                    pa.array(np.array(row["parts"][cut], np.int8) == HELD_OUT),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((c1 > 0).astype(np.int64), first)),
                    pa.array(np.full(len(sizes), totals["learned"], np.int64)),
                    pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(np.log10(p), first)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return laid.select("ids", "parts", "sizes", "c1", "c2").mapInArrow(score, SCORED)


def text_totals(chunks: DataFrame) -> dict[str, int]:
    """Texts and tokens that are learned from, and those of them that are deleted."""
    texts = chunks.select(F.explode(F.arrays_zip("parts", "sizes")).alias("t"))
    found = texts.groupBy("t.parts").agg(F.count("*").alias("texts"), F.sum("t.sizes").alias("tokens"))
    by_part = {r["parts"]: r for r in found.collect()}
    totals = {}
    for name, parts in (("learned", (DELETED, LEARNED)), ("deleted", (DELETED,))):
        own = [by_part[p] for p in parts if p in by_part]
        totals |= {name: sum(r["tokens"] for r in own), f"{name}_texts": sum(r["texts"] for r in own)}
    return totals


def text_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts whose checksum of the id ``FOLDS`` divides are not learned from. ``base_score`` is that of single
    tokens with ``ADDED`` to each count; both are sums of logarithms to the base ten.
    """
    # texts and chunks are long rows: what goes to Python at once is bounded by bytes
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    chunks = stage(texts.mapInArrow(chunked, CHUNKS), "chunks", long_rows=True)
    totals = text_totals(chunks)
    if ranges is None:
        tokens = chunks.agg(F.sum("n")).first()[0] or 0
        ranges = max(LEAST_RANGES, 1 << (tokens // RANGE_KEYS).bit_length())
    answers = asked(chunks, ranges).groupBy("kind", "span").applyInPandas(answer, ANSWERED)
    answers = stage(answers, "answers")
    totals["known"] = answers.where("kind = 1").agg(F.sum("known")).first()[0] or 0
    laid = stage(laid_out(chunks, answers.drop("known"), totals), "laid", long_rows=True)
    told = laid.select(F.explode("cells").alias("c")).groupBy("c.bucket", "c.x", "c.y")
    told = told.agg(*[F.sum(f"c.{x}").alias(x) for x in ("n", "log_x", "log_y")])
    # bounded by the buckets of a context and the cells of two ratios
    weights = learned_weights(told.toPandas().sort_values(["bucket", "x", "y"], ignore_index=True))
    return scored(laid, weights, totals)


def document_scores(docs: DataFrame) -> DataFrame:
    """Scores of all ``documents``."""
    return text_scores(docs).withColumnRenamed("id", "doc_id")
