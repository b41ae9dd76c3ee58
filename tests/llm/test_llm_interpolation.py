"""The interpolated bigram model against counts and mixtures worked out token by token."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from loomgrid import session
from loomgrid.llm import deleted_interpolation as di

SCHEMA = "doc_id bigint, text string, score string, n int"


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def part(doc_id):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    return "held" if h % 10 == 0 else "deleted" if doc_id is not None and h // 10 % 10 == 0 else "learned"


class Brute:
    """Counts of some texts and the estimates from them."""

    def __init__(self, texts):
        self.one, self.two, self.before = Counter(), Counter(), Counter()
        for words in texts:
            for a, b in zip([b"\n", *words], words):
                self.one[b] += 1
                self.two[a, b] += 1
                self.before[a] += 1
        self.n = sum(self.one.values())

    def estimates(self, a, b, known):
        context = self.before[a]
        alone = self.one[b] / max(self.n, 1)
        return context, (self.two[a, b] / context if context else 0.0, alone, 1 / (known + 1))


def bucket(count):
    return 0 if not count else 1 + math.floor(math.log2(count) * di.CONTEXTS_PER_OCTAVE)


def brute_weights(cases, size):
    """Mixture weights by expectation-maximisation over single tokens (bucket, estimates)."""

    def learn(weights, cases, prior):
        for _ in range(300):
            made = [list(p) for p in prior]
            for b, p in cases:
                share = [w * x for w, x in zip(weights[b], p)]
                for k in range(3):
                    made[b][k] += share[k] / sum(share)
            weights = [[x / sum(row) for x in row] for row in made]
        return weights

    overall = learn([[1 / 3] * 3], [(0, p) for _, p in cases], [[1 / 3] * 3])[0]
    prior = [[di.PRIOR * x for x in overall] for _ in range(size)]
    prior[0][0] = 0.0
    return learn([[x / sum(row) for x in row] for row in prior], cases, prior)


def corpus(seed, many=260):
    draw = random.Random(seed)
    follow = {f"w{i}": [f"w{draw.randrange(60)}" for _ in range(3)] for i in range(300)}
    rows = []
    for i in range(many):
        word, words = f"w{draw.randrange(60)}", []
        for _ in range(draw.randrange(40)):
            words.append(word.upper() if draw.random() < 0.1 else word)
            word = draw.choice(follow[word]) if draw.random() < 0.7 else f"w{int(draw.expovariate(0.1))}"
        rows.append((i, draw.choice([" ", "\n", "\t  "]).join(words)))
    return rows


ODD = [
    (None, "w1 w2 w3"),
    (None, None),
    (3, ""),
    (3, " \x0b "),
    (4, "É é   \x1c" + " w1" * 20_000),
    (4, "É é   \x1c" + " w1" * 20_000),
]


def brute(rows, weights=None):
    """(id, held, n, known, train tokens, base, score) of every row."""
    texts = [(i, part(i), tokens(t)) for i, t in rows]
    model = Brute(w for _, p, w in texts if p != "held")
    known = len(model.one)
    if weights is None:
        rest = Brute(w for _, p, w in texts if p == "learned")
        cases = []
        for _, p, words in texts:
            if p == "deleted":
                for a, b in zip([b"\n", *words], words):
                    context, told = rest.estimates(a, b, known)
                    cases.append((bucket(context), told))
        weights = brute_weights(cases, max([b for b, _ in cases], default=0) + 1)
    out = []
    for i, p, words in texts:
        score = base = 0.0
        for a, b in zip([b"\n", *words], words):
            context, told = model.estimates(a, b, known)
            row = weights[min(bucket(context), len(weights) - 1)]
            score += math.log10(sum(w * x for w, x in zip(row, told)))
            base += math.log10((model.one[b] + 0.1) / (model.n + 0.1 * (known + 1)))
        n_known = sum(b in model.one for b in words)
        out.append((i, p == "held", len(words), n_known, model.n, base, score))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in di.text_scores(docs, **more).collect()], key=str)


def close(mine, told, rel):
    assert [x[:5] for x in mine] == [x[:5] for x in told]
    assert [x[5] for x in mine] == pytest.approx([x[5] for x in told], rel=1e-9)
    assert [x[6] for x in mine] == pytest.approx([x[6] for x in told], rel=rel)


def test_scores_with_given_weights_are_exact(spark, monkeypatch):
    weights = np.array([[0.0, 0.7, 0.3], [0.2, 0.5, 0.3], [0.5, 0.4, 0.1], [0.6, 0.3, 0.1]])
    monkeypatch.setattr(di, "learned_weights", lambda told: weights)
    rows = corpus(1) + ODD
    close(found(spark, rows, ranges=16), brute(rows, weights.tolist()), 1e-9)


def test_weights_are_those_of_single_tokens(spark):
    rows = corpus(2)
    close(found(spark, rows), brute(rows), 2e-3)


def test_weights_equal_maximisation_over_tokens():
    draw = np.random.default_rng(4)
    n = 3000
    bucket_of = draw.integers(0, 5, n)
    p = 2.0 ** -draw.uniform(0, 12, (n, 3))
    p[bucket_of == 0, 0] = 0
    p[draw.random(n) < 0.2, 0] = 0
    p[:, 2] = 1 / 512
    told = pd.DataFrame(di.cells(bucket_of, p[:, 0] * 512, p[:, 1] * 512))
    mine = di.learned_weights(told)
    assert mine == pytest.approx(np.array(brute_weights(list(zip(bucket_of, p.tolist())), 5)), abs=0.01)
    assert mine.sum(axis=1) == pytest.approx(1)


def test_empty_and_untrained_tables(spark):
    assert found(spark, []) == []
    held = next(i for i in range(100) if part(i) == "held")
    ((_, is_held, n, known, train, base, score),) = found(spark, [(held, "a b")])
    assert (is_held, n, known, train, base) == (True, 3, 0, 0, 0.0) and math.isfinite(score) and score <= 0


def test_packing_is_exact():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64))
    assert (di.unpack_sorted(di.pack_sorted(keys)) == keys).all()
    assert di.unpack(di.pack(np.zeros(0, np.uint64))).tolist() == []


def test_a_chunk_takes_few_bytes_a_token():
    """Besides its hashes and numbers, an order takes some thirty bytes a token while it is made, and keeps twelve."""
    many = 200_000
    draw = np.random.default_rng(8)
    hashes = draw.integers(0, 2**64, 30_000, np.uint64)
    numbers = draw.integers(0, len(hashes), many).astype(np.uint64)
    row = {"sizes": [many // 2] * 2, "parts": [di.LEARNED, di.HELD_OUT], "hashes": hashes.tobytes()}
    row["numbers"] = di.pack(numbers)
    tracemalloc.start()
    try:
        chunk = di.Chunk(row)
        kept = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        keys, place = chunk.order(2)
        peak = tracemalloc.get_traced_memory()[1] - kept
    finally:
        tracemalloc.stop()
    assert kept < 6 * many and peak < 40 * many
    wanted, places = np.unique(chunk.pairs(), return_inverse=True)
    assert (keys == wanted).all() and (place == places).all()


def test_long_rows_are_written_in_small_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(session.LONG_ROWS, "parquet.block.size", "100000")
    rows = spark.range(0, 40, 1, 1).selectExpr("id", "randstr(20000, 3) AS text")
    session.stage(rows, folder=str(tmp_path), long_rows=True)
    (file,) = tmp_path.glob("*/*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert groups.num_rows == 40 and groups.num_row_groups > 5


def test_pieces_of_texts_are_whole_and_bounded(monkeypatch):
    monkeypatch.setattr(di, "PIECE_TOKENS", 10)
    sizes = [3, 3, 3, 3, 25, 1, 1, 9, 10]
    cuts = list(di.text_pieces(np.cumsum(sizes)))
    assert [sizes[c] for c in cuts] == [[3, 3, 3], [3], [25], [1, 1], [9], [10]]
