"""Merkle manifest of a table: a tree of digests per group, their roots in one tree above, and a proof per row.

Every row is a leaf, the digest of its fields. In each group the leaves are ordered by key; every two
consecutive nodes become the digest of both, a last one alone becomes its own digest, until one node is
left: the group's subroot (a lone leaf is that itself). Subroots, ordered by group, give the root alike.

Leaves are numbered by ranges and cut into superblocks of ``2 ** DEPTH``, aligned so that no pair of a
lower level crosses them. Superblocks are reduced to one node each, those nodes again, and so on until a
block holds a whole tree. On the way down the nodes of a block meet the few outer nodes that their proofs
need (``cogroup`` by superblock): the local reduction is done again there, its siblings are joined to the
outer ones, and the leaf, or a changed one, is folded up to the root in the same call. No task holds more
than a superblock and one path.

A path has one entry a level: ``L`` or ``R`` and the sibling that stands left or right, or ``-`` for none.

Defined results: a null field is ``-``, any other its UTF-8 length, a colon and its value; a null group
comes first; rows of equal keys are ordered by leaf and a null key comes first; equal rows are
leaves of their own; an empty table gives no rows; other columns of the table play no part.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.numbering import number_in_order
from loomgrid.session import stage

#: levels of a superblock
DEPTH = 11
NODE = "tree string, pos bigint, n bigint, digest string"
PROVED = "id {kind}, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """Digest of a row's fields."""
    told = []
    for field in fields:
        value = field.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def levels(n: int, depth: int) -> int:
    """Levels that a block of a tree of ``n`` nodes has."""
    return min(depth, (n - 1).bit_length())


def layers(digests: list[str], height: int) -> list[list[str]]:
    """The nodes of a block, level by level."""
    found = [digests]
    for _ in range(height):
        below = found[-1]
        found.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return found


def siblings(found: list[list[str]], at: int) -> list[str]:
    """Path of the node ``at`` to the top of its block."""
    path = []
    for below in found[:-1]:
        other = at ^ 1
        path.append(("R" if other > at else "L") + below[other] if other < len(below) else "-")
        at >>= 1
    return path


def folded(node: str, path: Iterable[str]) -> str:
    """What a node and its path give at the root."""
    for step in path:
        side, other = step[0], step[1:]
        node = digest(other + node if side == "L" else node + other if side == "R" else node)
    return node


def in_blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", depth))


def reduced(nodes: DataFrame, depth: int) -> DataFrame:
    """The top node of every superblock of ``nodes (tree, pos, n, digest)``."""

    def top(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iloc[0])
        ordered = block.sort_values("pos")["digest"].tolist()
        node = layers(ordered, levels(n, depth))[-1][0]
        return pd.DataFrame([(key[0], key[1], -(-n >> depth), node)], columns=["tree", "pos", "n", "digest"])

    return in_blocks(nodes, depth).groupBy("tree", "block").applyInPandas(top, NODE)


def paths(nodes: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """(tree, pos, path, top) of ``nodes``: siblings up to the top of their tree and further along the
    path that ``above (tree, pos, path, top)`` has for it, and the last node that this leads to.

    ``above`` is about the blocks of ``nodes``; without it a block is a tree and ends there.
    """
    kind = "tree string, pos bigint, path array<string>, top string"

    def local(block: pd.DataFrame, outer: list[str], top: str | None) -> pd.DataFrame:
        block = block.sort_values("pos")
        found = layers(block["digest"].tolist(), levels(int(block["n"].iloc[0]), depth))
        path = [siblings(found, at) + outer for at in range(len(block))]
        told = block[["tree", "pos"]].assign(top=found[-1][0] if top is None else top)
        told.insert(2, "path", path)
        return told

    blocks = in_blocks(nodes, depth).groupBy("tree", "block")
    if above is None:
        return blocks.applyInPandas(lambda block: local(block, [], None), kind)

    def joined(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        return local(block, list(over["path"].iloc[0]), over["top"].iloc[0])

    outer = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return blocks.cogroup(outer).applyInPandas(joined, kind)


def climbed(nodes: DataFrame, most: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """The subroots of all trees, the largest of ``most`` nodes, and the nodes of every level of blocks."""
    found = [nodes]
    while True:
        blocks = stage(reduced(found[-1], depth), "blocks")
        most = -(-most >> depth)
        if most <= 1:
            return blocks, found
        found.append(blocks)


def tree_of(group: Column) -> Column:
    """Name of a group's tree that is never null and sorts as groups do."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def manifest(
    df: DataFrame, key: str, group: str, fields: list[str], changed: Column | None = None, depth: int = DEPTH
) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of every row.

    ``changed`` is the leaf of a row that was tampered with, or null; ``folded_root`` is recomputed from
    it, or else from the row's own leaf, along the proof. ``verified`` says that it is the root.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(
        tree_of(F.col(group)).alias("tree"),
        F.struct(F.col(key).alias("id"), leaf(F.col(f) for f in fields).alias("leaf")).alias("order"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    rows = stage(number_in_order(rows, ["tree"], "order", "pos"), "leaves")
    sizes = stage(rows.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    rows = rows.select("tree", "pos", F.col("order.id").alias("id"), F.col("order.leaf").alias("digest"), "changed")
    rows = rows.join(sizes, "tree")

    subroots, nodes = climbed(rows.select("tree", "pos", "n", "digest"), most, depth)
    subroots = stage(subroots.select("tree", F.col("digest").alias("subroot")), "subroots")
    trees = subroots.count()
    tops = subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("subroot").alias("digest"))
    tops = number_in_order(tops, ["all"], "name", "pos").withColumn("n", F.lit(trees).cast("bigint"))
    tops = stage(tops.withColumnRenamed("all", "tree"), "tops")
    _, above = climbed(tops.select("tree", "pos", "n", "digest"), trees, depth)
    over = None
    for level in reversed(above):
        over = stage(paths(level, over, depth), "paths")
    over = over.withColumnRenamed("tree", "all").join(tops.select("pos", F.col("name").alias("tree")), "pos")

    # from the subroots down: what a block's nodes need is the path of its top node
    outer = over.select("tree", F.lit(0).cast("bigint").alias("pos"), "path", "top")
    for level in reversed(nodes[1:]):
        outer = stage(paths(level, outer, depth), "paths")
    outer = outer.withColumnRenamed("pos", "block").join(subroots, "tree")

    def proved(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        found = layers(block["digest"].tolist(), levels(int(block["n"].iloc[0]), depth))
        beyond, subroot, root = list(over["path"].iloc[0]), over["subroot"].iloc[0], over["top"].iloc[0]
        proof = [siblings(found, at) + beyond for at in range(len(block))]
        start = block["changed"].where(block["changed"].notna(), block["digest"])
        ends = [folded(*x) for x in zip(start, proof)]
        return pd.DataFrame(
            {
                "id": block["id"],
                "leaf": block["digest"],
                "subroot": subroot,
                "root": root,
                "proof": proof,
                "folded_root": ends,
                "verified": [end == root for end in ends],
            }
        )

    leaves = in_blocks(rows, depth).groupBy("tree", "block")
    return leaves.cogroup(outer.groupBy("tree", "block")).applyInPandas(proved, PROVED.format(kind=kind))


def siblings_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.substring(step, 2, 64)), ""), 256)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Manifest of ``documents`` by language, with one more character told for ids whose crc32 7 divides."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    told = [(F.col(f) + 1 if f == "n_chars" else F.col(f)) for f in FIELDS]
    found = manifest(docs, "doc_id", "lang", FIELDS, F.when(tampered, leaf(told)), depth)
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        siblings_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        "verified",
        F.size("proof").alias("proof_levels"),
    )
