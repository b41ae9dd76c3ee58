"""The three trained operators: held-out accuracy, gradients and unusual rows."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from loomgrid.llm import language, quality, toxicity
from loomgrid.llm.rows import documents, labels
from loomgrid.llm.wordhash import find_words

SF = "/root/testdata/sf0.01"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n 12 !"), (10**6 + 3, "ab " * 60_000), (None, "some words")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, None, "s", 7) for i, t in ODD], "doc_id long, text string, lang string, source string, score int")
    return documents(spark, SF).drop("n_chars").unionByName(odd, allowMissingColumns=True)


def scored(df, label, spark):
    rows = df.toPandas()
    truth = labels(spark, SF).toPandas().set_index("doc_id")[label]
    known = rows[rows["doc_id"].isin(truth.index) & rows["held_out"]]
    y = truth.loc[known["doc_id"]].to_numpy()
    assert rows["score"].between(0, 1).all() and len(rows) == 1005
    assert {"lang", "source", "text"} <= set(rows.columns) and list(rows.columns).count("score") == 1
    return known["predicted"].to_numpy(), y


def test_toxicity_on_held_out_rows(spark, docs):
    predicted, y = scored(toxicity.with_toxicity(docs, labels(spark, SF)), "toxic", spark)
    assert (predicted == y).mean() > 0.93 and predicted[y == 0].mean() < 0.03


def words_and_pairs(text):
    """Features by their words instead of hashes: words, and pairs with none, one or two words between."""
    words = re.findall(r"[a-z]+", text or "")
    pairs = [(step, *pair) for step in (1, 2, 3) for pair in zip(words, words[step:])]
    return {(w,) for w in words} | set(pairs) | {"bias"}


def ftrl_by_dictionaries(rows):
    """Weight of a feature after learning ``rows (features, label)``, one coordinate at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        rate = (toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2
        return (toxicity.L1 - z[f] if z[f] > 0 else -toxicity.L1 - z[f]) / rate

    counts = collections.Counter(y for _, y in rows)
    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(rows)):
            features, y = rows[i]
            odds = {f: weight(f) for f in features}
            p = 1 / (1 + math.exp(-sum(odds.values())))
            g = min(max(counts.values()) / counts[y], toxicity.MOST_WEIGHT) * (p - y)
            for f, w in odds.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w
                n[f] += g * g
    return weight


def test_toxicity_equals_ftrl_on_dictionaries(spark):
    draw = np.random.default_rng(3)
    plain, bad = "river stone cloud garden window letter winter".split(), "rotten vile hateful".split()
    rows = []
    for i in range(120):
        words = list(draw.choice(plain, 12))
        if i % 4 == 0:
            # a word alone, and two that tell something only with others between them
            words[3], words[6] = bad[i % 3], "vile"
            words[8:11] = ["stone", "cloud", "hateful"]
        rows.append((i, " ".join(words) if i != 7 else None, int(i % 4 == 0)))
    # a repeated label, a null one and one without a document
    told = [(i, y) for i, _, y in rows] + [(0, 0), (5, None), (999, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    found = toxicity.with_toxicity(docs, spark.createDataFrame(told, "doc_id long, toxic int")).toPandas()
    learned = [(words_and_pairs(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    weight = ftrl_by_dictionaries(learned)
    wanted = {i: 1 / (1 + math.exp(-sum(map(weight, words_and_pairs(t))))) for i, t, _ in rows}
    assert dict(zip(found["doc_id"], found["score"])) == pytest.approx(wanted, rel=1e-5)
    assert {i for i in wanted if zlib.crc32(str(i).encode()) % 5 == 0} == set(found["doc_id"][found["held_out"]])
    # pairs and words have learned, and most of the others have no weight
    features = set().union(*(f for f, _ in learned))
    used = [f for f in features if weight(f)]
    assert {len(f) for f in used if f != "bias"} == {1, 3} and len(used) < len(features) / 2


def test_quality_on_held_out_rows(spark, docs):
    predicted, y = scored(quality.with_quality(docs, labels(spark, SF)), "quality", spark)
    assert (predicted == y).mean() > 0.95 and predicted[y == 1].mean() > 0.98


def test_quality_steps_down_the_non_negative_risk(monkeypatch):
    """Slopes of every step are differences of the risk, worked out row by row; below nothing the other way."""
    draw, prior, signs = np.random.default_rng(8), 0.6, []
    pos = np.column_stack([draw.normal(1.5, 1, (40, 3)), np.ones(40)])
    web = np.column_stack([draw.normal(0, 1.5, (120, 3)), np.zeros(120)])
    step = quality.Net.step

    def parts(z, n):
        plus = prior * sum(math.log(1 + math.exp(-v)) for v in z[:n]) / n
        minus = sum(math.log(1 + math.exp(v)) for v in z[n:]) / (len(z) - n)
        return plus, minus - prior * sum(math.log(1 + math.exp(v)) for v in z[:n]) / n

    def watched(net, x, slope):
        z, n = net.logit(x).tolist(), int(x[:, 3].sum())
        signs.append(parts(z, n)[1] >= 0)
        if len(signs) % 50 == 1 or not signs[-1]:
            for i in (0, n - 1, n, len(z) - 1):
                more, less = list(z), list(z)
                more[i], less[i] = z[i] + 1e-5, z[i] - 1e-5
                up, down = parts(more, n), parts(less, n)
                risk = sum(up) - sum(down) if signs[-1] else down[1] - up[1]
                assert slope[i] == pytest.approx(risk / 2e-5, abs=1e-7)
        step(net, x, slope)

    monkeypatch.setattr(quality.Net, "step", watched)
    quality.non_negative(pos, web, prior)
    assert {True, False} == set(signs)


def test_class_prior_equals_the_least_bound_over_thresholds():
    draw = np.random.default_rng(9)
    pos = draw.normal(2, 1, 400).round(2)
    web = np.concatenate([draw.normal(2, 1, 300), draw.normal(-3, 1, 700)]).round(2)
    doubt = math.sqrt(math.log(40) / 2) * (400**-0.5 + 1000**-0.5)
    bounds = []
    for cut in sorted(set(pos.tolist())):
        p, u = sum(v >= cut for v in pos) / 400, sum(v >= cut for v in web) / 1000
        bounds.append(((u + doubt) / p, u / p))
    assert quality.class_prior(pos, web) == pytest.approx(min(bounds)[1])
    assert quality.class_prior(pos, web) == pytest.approx(0.3, abs=0.05)


def test_language_on_held_out_rows(spark, docs):
    rows = language.with_language(docs).toPandas()
    held = rows[rows["held_out"] & rows["lang"].notna()]
    assert len(rows) == 1005 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    odd = rows[rows["doc_id"].isin([10**6, 10**6 + 1, 10**6 + 2])]
    assert set(odd["lang_pred"]) == {"und"} and (odd["score"] == 0).all()
    kept = language.keep_sure(docs).toPandas()
    assert not set(kept["doc_id"]) & {10**6, 10**6 + 1, 10**6 + 2} and len(kept) > 980
    assert list(kept.columns) == docs.columns


@pytest.mark.parametrize("with_model", [toxicity.with_toxicity, quality.with_quality])
def test_no_labels_and_no_rows(spark, docs, with_model):
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    some = docs.limit(20)
    assert with_model(some, none).select("score").distinct().count() == 1
    assert with_model(docs.limit(0), none).count() == 0
    assert language.with_language(docs.limit(0)).count() == 0


def read_byte_by_byte(reader, symbols):
    """States of a gated recurrent unit, one byte and one unit at a time."""
    u, h, states = reader.units, [0.0] * reader.units, []
    byte, state, bias = (w.astype(float).tolist() for w in reader.weights)
    logistic = lambda v: 1 / (1 + math.exp(-v))
    for s in symbols:
        inner = [sum(h[j] * state[j][k] for j in range(u)) for k in range(3 * u)]
        after = []
        for k in range(u):
            z, r = logistic(byte[s][k] + inner[k]), logistic(byte[s][u + k] + inner[u + k])
            candidate = math.tanh(byte[s][2 * u + k] + r * (inner[2 * u + k] + bias[k]))
            after.append(z * h[k] + (1 - z) * candidate)
        h = after
        states.append(h)
    return states


def test_states_lie_by_windows():
    """Windows are the last axis, in rows of memory, and each is read as if it were alone."""
    reader = language.Tagger(["a", "b"]).ahead
    symbols = np.random.default_rng(3).integers(0, 256, (5, 7)).astype(np.uint8)
    states = reader.read(symbols)
    assert states.shape == (5, reader.units, 7) and states.flags.c_contiguous
    wanted = [read_byte_by_byte(reader, column) for column in symbols.T.tolist()]
    np.testing.assert_allclose(states, np.transpose(wanted, (1, 2, 0)), atol=1e-5)


def test_pooled_labels_equal_a_loop_over_bytes():
    """Every byte of every window is labelled, and a text's probabilities are their mean."""
    model = language.Tagger(["a", "b", "c"])
    texts = [b"", b"x", "Stra\u00dfe und Wege".encode(), b"a text of more than one window, " * (language.WINDOW // 20)]
    out, base = model.out.astype(float), model.base.astype(float)
    wanted = []
    for text in texts:
        told = []
        symbols, filled = language.windows([text])
        assert sum(filled) == len(text)
        for column, count in zip(symbols.T.tolist(), filled):
            ahead = read_byte_by_byte(model.ahead, column)
            behind = read_byte_by_byte(model.behind, column[::-1])[::-1]
            for t in range(count):
                odds = np.exp(np.array(ahead[t] + behind[t]) @ out + base)
                told.append(odds / odds.sum())
        wanted.append(np.mean(told, axis=0) if told else np.zeros(3))
    np.testing.assert_allclose(model.pooled(texts), wanted, atol=2e-5)


def test_network_gradients_match_differences():
    model = language.Tagger(["a", "b", "c"])
    symbols, filled = language.windows([b"some text to read", b"noch ein Text" * 8, b"x"])
    truth = np.array([0, 1, 1, 2])
    grads = model.gradients(symbols, filled, truth)

    def loss():
        p, _, _ = model.label(symbols)
        inside = np.arange(len(symbols))[:, None] < filled
        return (-np.log(p[:, np.arange(4), truth]) * inside).sum() / filled.sum()

    for w, g in zip(model.weights, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = w[at]
        w[at] = kept + 0.01
        high = loss()
        w[at] = kept - 0.01
        low = loss()
        w[at] = kept
        assert (high - low) / 0.02 == pytest.approx(float(g[at]), rel=0.02)


def test_pooling_reads_every_byte_once():
    model = language.Tagger(["a", "b"])
    texts = [b"q" * n for n in (1, 63, 64, 65, 1000)]
    pooled = model.pooled(texts)
    assert pooled.sum(1) == pytest.approx(np.ones(5), abs=1e-4)
    p, _, _ = model.label(language.windows([texts[1]])[0])
    assert pooled[1] == pytest.approx(p[:63, 0].mean(0), abs=1e-5)


def test_class_prior_is_found():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(2, 1, 6000), draw.normal(-2, 1, 2000)
    assert quality.class_prior(draw.normal(2, 1, 4000), np.concatenate([good, bad])) == pytest.approx(0.75, abs=0.05)


def test_words_hash_alike_wherever_they_stand():
    words = find_words(["One two,ONE", None, "", "two é_é"])
    assert words.doc.tolist() == [0, 0, 0, 3, 3, 3]
    h = words.hash.tolist()
    assert h[0] == h[2] and h[1] == h[3] and h[4] == h[5] and len(set(h)) == 3
