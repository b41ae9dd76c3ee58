"""The Merkle manifest against a tree built in one place."""

import zlib
from hashlib import sha256

import pytest

from loomgrid.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, pos int"


def hexed(text):
    return sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_up(nodes):
    """All levels of a tree."""
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([hexed("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return found


def brute(rows):
    """(id, leaf, subroot, root, proof digest, folded root, verified), one per row, sorted."""
    groups = {}
    for row in rows:
        doc_id, source, lang, n_chars, text = row
        more = n_chars
        if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            more = n_chars + 1
        told = (doc_id is not None, doc_id or 0, brute_leaf(row), doc_id, brute_leaf((doc_id, source, lang, more, text)))
        groups.setdefault((lang is not None, (lang or "").encode()), []).append(told)
    trees = [brute_up([x[2] for x in sorted(groups[g])]) for g in sorted(groups)]
    top = brute_up([t[-1][0] for t in trees])
    out = []
    for at, (group, tree) in enumerate(zip(sorted(groups), trees)):
        for place, (*_, leaf, doc_id, changed) in enumerate(sorted(groups[group])):
            node, seen = changed, []
            for levels, i in ((tree, place), (top, at)):
                for below in levels[:-1]:
                    run = below[i // 2 * 2 : i // 2 * 2 + 2]
                    seen += [x for j, x in enumerate(run) if j != i % 2]
                    run[i % 2] = node
                    node, i = hexed("".join(run)), i // 2
            root = top[-1][0]
            out.append((doc_id, leaf, tree[-1][0], root, hexed("".join(seen)), node, node == root))
    return sorted(out, key=str)


ODD = [
    (None, None, None, None, None),
    (None, "s", "en", 3, ""),
    (7, "s", None, None, "x" * 30_000),
    (5, "s", "en", 1, "a"),
    (5, "s", "en", 1, "a"),
    (5, "t", "en", 1, "b"),
    (11, "", "", 0, ""),
    (12, "ß", "é", 2, "ein Wort"),
]
MANY = [(i, f"s{i % 3}", ["en", "de", "fr", None][min(i % 9, 3)], i * 3, f"text {i}\n") for i in range(150)]


@pytest.mark.parametrize("rows, depth", [(ODD, 11), (ODD, 1), ([*ODD, *MANY], 2), (MANY[:1], 11), (MANY, 5)])
def test_manifest_equals_the_tree_built_in_one_place(spark, rows, depth):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    found = merkle.document_manifest(docs, depth).drop("proof_levels").collect()
    assert sorted([tuple(r) for r in found], key=str) == brute(rows)


def test_an_empty_table_has_no_rows(spark):
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampered_rows_alone_do_not_verify(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in MANY], SCHEMA)
    found = {r.doc_id: r.verified for r in merkle.document_manifest(docs).collect()}
    tampered = {i for i in found if zlib.crc32(str(i).encode()) % 7 == 0}
    assert tampered and {i for i, good in found.items() if not good} == tampered
