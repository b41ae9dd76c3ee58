"""Near copies by the Jaccard likeness of their five-word shingles, and by SimHash.

Two texts are near copies when they share at least ``LIKE`` of all their distinct shingles, or, where asked
for, when their SimHash fingerprints are linked. A text's sketch has the minima of ``BANDS * ROWS`` hashes;
texts meet in a bucket when they agree on all minima of a band (a pair at 0.8 does so in some band with a
probability of 0.99995). A pair that shares ``LEAST_SHARED`` minima is likely, which is over four deviations
below what a pair at 0.8 shares. The likely pairs of all buckets connect sets to clusters; a bucket tells
the clusters inside it only. Then the texts of a cluster meet, and every likely pair in it is measured on
the whole sets, but for pairs that measured links connect already. So a link is never given up for an
estimate, and no pair is emitted that does not connect two parts. Links connect groups by star steps.

Only distinct sets of shingles are compared. A bucket of more than ``TILE`` members, and a cluster of more
than ``CLUSTER`` members or ``CLUSTER_CHARS`` characters, is cut into blocks, every two of which are compared by
a task of their own. Texts are shuffled twice: to find those of the clusters, and to drop rows at the end.

Defined results: words lie between ASCII white space, ASCII letters are compared in lower case; a text of
fewer than five words is one shingle; texts without words are copies of each other; the row kept of a
group is that with the smallest id, rows without id last; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm import simhash
from loomgrid.llm.components import connected
from loomgrid.llm.quality import SOLID
from loomgrid.llm.rows import wrap
from loomgrid.llm.wordhash import block_hash, chunks, find_words, mixed
from loomgrid.session import stage

LIKE = 0.8
SHINGLE = 5
BANDS, ROWS = 25, 5
TILE = 1024
BUFFER = 50_000
BLOCK = 2048
# minima that a pair shares at least to be looked at: over four deviations below those of a pair at 0.8
LEAST_SHARED = 80
CLUSTER = 512
CLUSTER_CHARS = 4_000_000
# likely pairs are measured in this order, so that most are connected before their turn
LOOKS = (115, 100, LEAST_SHARED)

draw = np.random.default_rng(5)
TIMES = draw.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
PLUS = draw.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    words = find_words(texts, SOLID, hashed=block_hash)
    bounds = np.searchsorted(words.doc, np.arange(words.n_docs + 1))
    window = words.hash[: max(len(words.hash) - width + 1, 0)].copy()
    for k in range(1, width):
        window = mixed(window * STEP + words.hash[k : k + len(window)])
    found = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= width:
            found.append(np.unique(window[a : b - width + 1]))
            continue
        whole = words.hash[a : min(a + 1, b)].copy()
        for k in range(a + 1, b):
            whole = mixed(whole * STEP + words.hash[k : k + 1])
        found.append(whole)
    return found


def minima(hashes: np.ndarray) -> np.ndarray:
    parts = range(0, len(hashes), BLOCK)
    return np.min([(hashes[i : i + BLOCK] * TIMES + PLUS).min(axis=1) for i in parts], axis=0)


def signature(hashes: np.ndarray) -> tuple[str, list[int], bytes]:
    """Name of the set, its bucket keys, and one byte of each minimum."""
    if not len(hashes):
        return "", [], b""
    low = mixed(minima(hashes))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = mixed(keys * STEP + column)
    node = xxhash.xxh3_128_hexdigest(hashes.tobytes())
    return node, keys.view(np.int64).tolist(), low.astype(np.uint8).tobytes()


def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, chars, fp, node, keys, sketch) of batches of (id, t, text), a chunk at a time."""
    for batch in batches:
        at = 0
        for texts in chunks(batch["text"].to_pylist()):
            told = [signature(s) for s in shingle_sets(texts)]
            node, keys, sketch = zip(*told)
            part = batch.slice(at, len(texts))
            at += len(texts)
            arrays = [
                part["id"],
                part["t"],
                pa.array([len(x or "") for x in texts], pa.int64()),
                pa.array([simhash.fingerprint(x) for x in texts], pa.int64()),
                pa.array(node, pa.string()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(sketch, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "t", "chars", "fp", "node", "keys", "sketch"])


class Forest:
    """Trees over numbered rows, joined as links are found."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        root = self.root
        while len(u):
            a, b = root[u], root[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        self.root = root

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        row = np.flatnonzero(self.root != np.arange(len(self.root)))
        return row, self.root[row]


def pairs_within(stop: np.ndarray, block: np.ndarray, within: np.ndarray, forest: Forest) -> Iterator[tuple]:
    """Pairs of rows of one run in turns, without those that the forest connects by then.

    ``stop`` is the last row of a row's run; ``within`` says that rows of one block are compared.
    """
    rows, step = np.flatnonzero(stop > np.arange(len(stop))), 1
    while len(rows):
        u, v = rows, rows + step
        met = (within[u] | (block[u] != block[v])) & (forest.root[u] != forest.root[v])
        yield u[met], v[met]
        step += 1
        rows = rows[stop[rows] - rows >= step]


def shared(sketch: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    found = np.empty(len(u), np.int16)
    for at in range(0, len(u), BUFFER):
        cut = slice(at, at + BUFFER)
        found[cut] = (sketch[u[cut]] == sketch[v[cut]]).sum(axis=1, dtype=np.int16)
    return found


def in_runs(batches: Iterator[pa.RecordBatch], by: list[str], full: Callable[[pa.RecordBatch], float]) -> Iterator[tuple]:
    """Tables of whole runs of equal ``by`` and the last row of each row's run, of sorted rows.

    ``full`` tells how much of a table's worth a batch is.
    """
    kept: list[pa.RecordBatch] = []
    size = 0.0

    def cut(whole: bool):
        table = pa.Table.from_batches(kept)
        new = np.zeros(len(table), bool)
        for name in by:
            x = table[name].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        n = len(table) if whole else int(np.flatnonzero(new)[-1]) if new.any() else 0
        last = np.flatnonzero(np.append(new[1:n], True)) if n else np.zeros(0, np.int64)
        return table.slice(0, n), last[np.searchsorted(last, np.arange(n))], table.slice(n)

    for batch in batches:
        kept.append(batch)
        size += full(batch)
        if size >= 1:
            table, stop, rest = cut(False)
            if len(table):
                yield table, stop
                kept = rest.to_batches()
                size = sum(map(full, kept))
    if sum(map(len, kept)):
        yield cut(True)[:2]


def sketches(table: pa.Table) -> np.ndarray:
    raw = b"".join(table["sketch"].to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(table), BANDS * ROWS)


def told(node: np.ndarray, forest: Forest) -> pa.RecordBatch:
    found = [pa.array(node[x], pa.string()) for x in forest.links()]
    return pa.RecordBatch.from_arrays(found, ["u", "v"])


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) that connect the likely pairs of sets, of rows sorted by (key, a, b)."""
    for table, stop in in_runs(batches, ["key", "a", "b"], lambda batch: len(batch) / BUFFER):
        a, b, block = (table[c].to_numpy() for c in ("a", "b", "block"))
        sketch, forest = sketches(table), Forest(len(table))
        for u, v in pairs_within(stop, block, a == b, forest):
            near = shared(sketch, u, v) >= LEAST_SHARED
            forest.join(u[near], v[near])
        yield told(table["node"].to_numpy(zero_copy_only=False), forest)


def alike(a: np.ndarray, b: np.ndarray, like: float) -> bool:
    """Whether two sorted sets share ``like`` of all their members."""
    if min(len(a), len(b)) < like * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= like * (len(a) + len(b) - common)


def measured(like: float) -> Callable:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(u, v) that connect the near copies among the rows of a cluster, sorted by (root, a, b)."""
        worth = lambda batch: batch["text"].nbytes / CLUSTER_CHARS
        for table, stop in in_runs(batches, ["root", "a", "b"], worth):
            a, b, block = (table[c].to_numpy() for c in ("a", "b", "block"))
            sketch, forest = sketches(table), Forest(len(table))
            sets = [s for part in chunks(table["text"].to_pylist()) for s in shingle_sets(part)]
            for least, below in zip(LOOKS, (BANDS * ROWS + 1, *LOOKS)):
                for u, v in pairs_within(stop, block, a == b, forest):
                    n = shared(sketch, u, v)
                    look = (n >= least) & (n < below)
                    for x, y in zip(u[look].tolist(), v[look].tolist()):
                        if forest.root[x] != forest.root[y] and alike(sets[x], sets[y], like):
                            forest.join(np.array([x]), np.array([y]))
            yield told(table["node"].to_numpy(zero_copy_only=False), forest)

    return links


def in_tiles(rows: DataFrame, by: str, sizes: DataFrame) -> DataFrame:
    """``rows`` with their tile (a, b): every two of the blocks that ``sizes (by, blocks)`` has."""
    rows = rows.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    return rows.drop("other", "blocks")


def clusters(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, root) of the sets that likely pairs connect, of ``sets (node, keys, sketch)``."""
    keys = sets.select(F.explode("keys").alias("key"), "node")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = stage(sizes.select("key", F.ceil(F.col("n") / tile).alias("blocks")), "sizes")
    rows = in_tiles(keys, "key", sizes).join(sets.select("node", "sketch"), "node")
    rows = rows.select("key", "a", "b", "block", "node", "sketch")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    roots = connected(rows.mapInArrow(likely, "u string, v string"))
    return stage(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "clusters")


def near_links(sets: DataFrame, texts: DataFrame, like: float = LIKE, tile: int = TILE) -> DataFrame:
    """(u, v) that connect the near copies of ``sets (node, t, chars, keys, sketch)``; ``texts (t, text)``."""
    members = sets.select("node", "t", "chars", "sketch").join(clusters(sets, tile), "node")
    members = stage(members, "cluster")
    room = F.greatest(F.count("*") / min(tile, CLUSTER), F.sum("chars") / CLUSTER_CHARS)
    sizes = stage(members.groupBy("root").agg(F.ceil(room).alias("blocks")), "sizes")
    found = texts.join(members.select("t", "node"), "t").groupBy("node").agg(F.first("text").alias("text"))
    rows = in_tiles(members, "root", sizes).drop("t", "chars").join(found, "node")
    rows = rows.select("root", "a", "b", "block", "node", "sketch", "text")
    rows = rows.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    return stage(rows.mapInArrow(measured(like), "u string, v string"), "near")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(u, v) of sets of shingles whose texts SimHash links, each to the first set of its component."""
    fps = stage(prints.select("fp").distinct(), "fps")
    roots = connected(simhash.neighbour_links(fps))
    member = prints.join(roots, prints["fp"] == roots["node"], "left")
    member = member.select(F.coalesce("root", "fp").alias("root"), prints["node"].alias("v")).distinct()
    member = stage(member, "members")
    first = member.groupBy("root").agg(F.min("v").alias("u"))
    return member.join(first, "root").where("u <> v").select("u", "v")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; an own value for null."""
    return F.coalesce(F.md5(text), F.lit(""))


def keep_one(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    like: float = LIKE,
    tile: int = TILE,
    by_fingerprint: bool = False,
) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, once.

    With ``by_fingerprint`` links of SimHash fingerprints join groups as well.
    """
    rows = wrap(df, id=doc_id, text=text).withColumn("t", text_key(F.col("text")))
    kind = df.schema[doc_id].dataType.simpleString()
    prints = rows.select("id", "t", "text").mapInArrow(
        printed, f"id {kind}, t string, chars bigint, fp bigint, node string, keys array<bigint>, sketch binary"
    )
    prints = stage(prints, "prints")
    sets = prints.groupBy("node").agg(F.min(F.struct("t", "chars", "keys", "sketch")).alias("s"))
    sets = stage(sets.select("node", "s.*"), "distinct")
    links = near_links(sets, rows.select("t", "text"), like, tile)
    if by_fingerprint:
        links = links.union(fingerprint_links(prints.select("fp", "node")))
    roots = connected(links)
    groups = prints.select("id", "t", "node").join(roots, "node", "left")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("best")
    best = groups.groupBy(F.coalesce("root", "node").alias("root")).agg(best)
    row_key = F.concat_ws(":", F.col("id").cast("string"), "t").alias("row_key")
    kept = stage(best.select("best.*").select(row_key), "kept")
    found = rows.select("_row", row_key).join(kept, "row_key", "left_semi")
    return found.dropDuplicates(["row_key"]).select("_row.*")
