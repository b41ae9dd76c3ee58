"""Spelling variants against brute force."""

import random
import re
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def brute_words(rows):
    total = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                total[run] = total.get(run, 0) + 1
    return {w: n for w, n in total.items() if n >= 5}


def brute(words):
    forms, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
        out[w] = [n, len(near), forms[w], words[best] if forms[w] else None]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, **more).collect()}


def texts(seed, many=60):
    """Words over few letters with counts of very different size, so that chains of forms arise."""
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abé") for _ in range(draw.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(many):
        words = []
        for _ in range(300):
            stem = stems[min(int(draw.expovariate(0.15)), 39)]
            at = draw.randrange(len(stem))
            if draw.random() < 0.15:
                stem = stem[:at] + draw.choice(["", "b", "xé"]) + stem[at + 1 :]
            words.append(stem.title() if draw.random() < 0.1 else stem)
        rows.append((i, ", ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [spelling.TILE, 3])
def test_variants_equal_brute_force(spark, tile):
    rows = texts(3)
    told = brute(brute_words(rows))
    assert sum(x[2] is not None for x in told.values()) > 20
    assert any(told[x[2]][2] for x in told.values() if x[2])  # a chain
    assert found(spark, rows, tile=tile) == told


def test_odd_rows(spark):
    long = "ab" * 4000
    rows = [
        (None, None),
        (None, "Straße straße STRAßE ÷÷÷÷÷÷"),
        (1, ""),
        (2, "  1234567 абвгдежз " * 9),
        (3, f"{long} {long}b " * 6 + "strase " * 30),
        (3, "strasse " * 5 + "Straße"),
        (3, "strasse " * 5 + "Straße"),
        (4, "abcdeſabcdef" * 7),
    ]
    told = brute(brute_words(rows))
    assert found(spark, rows) == told and long in told
    assert found(spark, []) == {}


def test_batches_that_cut_groups_make_no_difference(spark, monkeypatch):
    words = brute_words(texts(5))
    table = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in words.items()], "word binary, n bigint")
    order = ["m", "side", "half", "a", "b"]
    rows = spelling.tiled(spelling.halves(table), 5).orderBy(*order, "rest").toArrow()
    whole = {tuple(x.items()) for b in spelling.scanned(iter(rows.to_batches())) for x in b.to_pylist()}
    monkeypatch.setattr(spelling, "BUFFER", 7)
    parts = rows.to_batches(max_chunksize=3)
    cut = [tuple(x.items()) for b in spelling.scanned(iter(parts)) for x in b.to_pylist()]
    assert whole and set(cut) == whole
    assert table.where(F.length("word") < 6).count() == 0


def tile_rows(spark, words, tile=spelling.TILE):
    table = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in words.items()], "word binary, n bigint")
    return spelling.tiled(spelling.halves(table), tile).orderBy("m", "side", "half", "a", "b", "rest").toArrow()


def summed(rows, many=50):
    """{word: (n_near, best near word)} by all that a scan tells of rows."""
    out = {}
    for batch in spelling.scanned(iter(rows.to_batches(max_chunksize=many))):
        for x in batch.to_pylist():
            n, best = out.get(x["word"], (0, (0, b"")))
            out[x["word"]] = n + x["n_near"], min(best, (x["less"], x["form"]))
    return {w.decode("latin-1"): (n, form.decode("latin-1")) for w, (n, (_, form)) in out.items()}


def test_rows_that_come_last_and_alone(spark, monkeypatch):
    rows = tile_rows(spark, {"abcdef": 5, "abcdex": 5})
    for at in range(len(rows)):
        assert summed(rows.slice(at, 1)) == {}
    monkeypatch.setattr(spelling, "BUFFER", 2)
    assert rows["side"].to_pylist() == [0, 0, 1, 1]
    assert summed(rows.slice(0, 3)) == {"abcdef": (1, "abcdex"), "abcdex": (1, "abcdef")}


@pytest.mark.parametrize("name, value", [("PAIRS", 1), ("PAIRS", 20), ("CELLS", 60)])
def test_parts_add_up_to_brute_force(spark, monkeypatch, name, value):
    words = brute_words(texts(7))
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    told = {w: (len(x), min(x, key=lambda y: (-words[y], y))) for w, x in near.items() if x}
    monkeypatch.setattr(spelling, name, value)
    rows = tile_rows(spark, words)
    assert len(told) > 100 and summed(rows) == told
    assert any(rows["b"].to_pylist()) == (name == "CELLS")


def peak_mb(rows):
    batches = rows.to_batches()
    tracemalloc.start()
    for _ in spelling.scanned(iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def rows_of(rests, m, n=5):
    k = len(rests)
    columns = {c: pa.array([x] * k, pa.int32()) for c, x in (("m", m), ("side", 0), ("a", 0), ("b", 0), ("block", 0))}
    columns |= {"half": pa.array([b"q" * (m // 2)] * k, pa.binary()), "rest": pa.array(rests, pa.binary())}
    return pa.table(columns | {"n": pa.array([n] * k, pa.int64())})


def test_memory_does_not_grow_with_the_pairs_of_a_tile():
    draw = random.Random(1)
    rests = sorted({bytes(draw.choices(range(97, 123), k=8)) for _ in range(12_000)})
    assert peak_mb(rows_of(rests, 16)) < 200


def test_one_long_word_does_not_widen_the_rows_of_short_ones():
    draw = random.Random(1)
    rests = sorted({bytes(draw.choices(range(97, 123), k=4)) for _ in range(1000)})
    table = pa.concat_tables([rows_of(rests, 8), rows_of([b"z" * 300_000], 600_000)]).combine_chunks()
    assert peak_mb(table) < 100


def test_words_of_a_task_are_bounded_by_their_letters(monkeypatch):
    monkeypatch.setattr(spelling, "STORE_LETTERS", 100)
    texts = [chr(97 + i) * 60 for i in range(6)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(6), pa.int64()), "text": texts})
    told = list(spelling.counted(iter([batch])))
    assert [len(x) for x in told] == [2, 2, 2]
    assert {x["word"] for b in told for x in b.to_pylist()} == {t.encode() for t in texts}
