"""Near copies by five-word Jaccard against brute force."""

import itertools
import random

import pytest

from loomgrid.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_kept(rows):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (len(a & b) / len(a | b) if a | b else 1) >= 0.8 and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    groups = {}
    for (i, _), x in zip(rows, label):
        groups.setdefault(x, []).append(i)
    return sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())


@pytest.mark.parametrize("tile", [1024, 7])
def test_one_of_each_group_is_kept(spark, tile):
    draw, texts = random.Random(4), []
    for group in range(40):
        base = [f"w{draw.randint(0, 5000)}" for _ in range(draw.choice([6, 60, 200, 400]))]
        for _ in range(40 if group == 0 else 4):
            at, n = draw.randrange(len(base)), draw.randint(0, len(base) // 6)
            texts.append(" ".join(base[:at] + [f"x{draw.random()}" for _ in range(n)] + base[at + n :]))
    draw.shuffle(texts)
    rows = [*enumerate(texts), (900, None), (901, " \n"), (902, "A b"), (903, "a  B"), (None, "lonely"), (None, "lonely")]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.keep_one(df, tile=tile)
    assert got.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == brute_kept(rows)
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_single_pairs_above_the_bound_are_found_among_many_below_it(spark):
    common = [f"c{i}" for i in range(304)]
    texts = []
    for i in range(90):
        own = [f"u{i}_{k}" for k in range(40)]
        if i in (20, 71):
            own[:5] = ["p", "q", "r", "s", "t"]
        texts.append(" ".join(common + own))
    a, b, c = (shingles(texts[i]) for i in (20, 71, 3))
    assert len(a & b) / len(a | b) > 0.8 > len(a & c) / len(a | c) > 0.78
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_copies.keep_one(df).collect()}
    assert kept == set(range(90)) - {71}


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, long), (4, long.replace("w7 ", "other ")), (6, long[:40_000]), (7, "")]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], "doc_id long, text string, t string, node int, id string")
    found = near_copies.keep_one(df, by_fingerprint=True)
    assert found.columns == df.columns
    assert {tuple(r) for r in found.collect()} == {(*r, "x", 1, None) for r in rows[1:]}


def test_fingerprints_join_groups_that_shingles_do_not(spark):
    words = [f"w{i}" for i in range(400)]
    changed = [w if i % 60 else "new" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, "another text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same = {r["component_id"] for r in near_copies.simhash.component_table(df).collect()}
    kept = {r["doc_id"] for r in near_copies.keep_one(df, like=0.99, by_fingerprint=True).collect()}
    assert kept == same
    assert {r["doc_id"] for r in near_copies.keep_one(df, like=0.99).collect()} == {1, 2, 3}
