"""SimHash near-dedup and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from loomgrid.llm import components, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    label = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for i in range(len(prints)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    members = {}
    for i, x in zip(ids, label):
        members.setdefault(x, []).append(i)
    return [min((m for m in members[x] if m is not None), default=None) for x in label]


@pytest.mark.parametrize("text", ["", None, "A", "One two THREE", "a b c d", "É  x\ty\x0bz a b", "same " * 50])
def test_prints_match_the_definition(text):
    assert simhash.fingerprint(text) % 2**64 == brute_print(text)


@pytest.mark.parametrize("depth,tile", [(2, 4096), (2, 5), (3, 7)])
def test_links_connect_all_within_the_distance(spark, depth, tile):
    draw = random.Random(depth + tile)
    seeds = [draw.getrandbits(64) for _ in range(30)]
    prints = {0, 2**64 - 1, *seeds}
    for s in seeds[:12]:
        for _ in range(8):
            flips = draw.sample(range(64), draw.randint(1, 6))
            prints.add(s ^ sum(1 << b for b in flips))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.neighbour_links(table, depth, tile)
    pairs = [(r["u"], r["v"]) for r in links.collect()]
    assert all(bin((u ^ v) % 2**64).count("1") <= 24 for u, v in pairs)
    roots = {r["node"]: r["root"] for r in components.connected(links).collect()}
    want = brute_components(signed, prints)
    got = [roots.get(p, p) for p in signed]
    assert len(set(got)) == len(set(want))
    assert {(g, w) for g, w in zip(got, want)} == {(w, w) for w in want}


def test_rows_of_all_kinds(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [
        (5, base, "x"), (3, base.upper(), "y"), (9, base + " end", "z"), (9, base + " end", "z"),
        (1, None, "n"), (2, " \n", "n"), (None, "lonely text of its own here", "q"), (7, "x " * 9000, "l"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, tile=2)
    assert got.columns == ["doc_id", "text", "fp", "fingerprint", "component_id"]
    prints = [brute_print(t) for _, t, _ in rows]
    want = brute_components([r[0] for r in rows], prints)
    found = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got.collect())
    assert found == sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows, prints, want))
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(df).collect()) == sorted(
        {str(c) for c in want if c is not None} | {"None"}
    )
    table = simhash.component_table(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in table) == sorted(
        (str(r[0]), str(c)) for r, c in zip(rows, want)
    )
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chains_connect(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 501), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected(links).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, 501: 500}


def test_forest_never_joins_blocks_that_are_not_compared():
    fp = np.array([0, 1, 3, 2**40], np.uint64)
    row, root = simhash.forest((np.ones(4, int), np.zeros(4, int)), np.array([0, 0, 1, 1]), np.zeros(4, bool), fp)
    assert sorted(zip(row.tolist(), root.tolist())) == [(1, 0), (2, 0), (3, 0)] or len(row) == 3
