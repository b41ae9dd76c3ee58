"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is cut into five ring segments. If two fingerprints differ in at most four
bits, the differences lie so that from some segment on, every chain of l consecutive segments has
at most floor(l * 4 / 5) differences: none in the first, at most 1 in the first two, 2 in three,
3 in four. Candidates are therefore rows that agree on one segment and, since the next one differs
in one bit at most, on one of its halves (with ``depth=3`` also on a third of the one after that).
Within a bucket the chain budgets prune the pairs before the full Hamming check.

Only distinct fingerprints are compared. A bucket emits a spanning forest of its links, at most
one per member, never all pairs; a bucket of more than ``TILE`` members is cut into tiles that
are compared by different tasks, every two blocks once, so the search is exact for any bucket.
Components follow from the links by star steps.

Defined results: a null or blank text has fingerprint 0 and is linked like any other; repeated rows
and ids count once; rows without id get the component of their fingerprint, whose id is null
if no member has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.components import connected
from loomgrid.llm.rows import unwrap, wrap
from loomgrid.session import stage

WIDTHS = (13, 13, 13, 13, 12)
DISTANCE = 4
SHINGLE = 4
SEED = 42
TILE = 4096
# members of a bucket that a depth of two is meant for, at 2 ** 19 buckets of a kind
DEEPER = 64 * 2**19
BUFFER = 100_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles, each occurrence counted."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[width - 1 :].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def chain_masks() -> np.ndarray:
    """[start, l - 1]: bits of the l segments from ``start`` on around the ring."""
    lows = np.cumsum([0, *WIDTHS])
    segments = [((1 << w) - 1) << int(low) for w, low in zip(WIDTHS, lows)]
    masks = np.zeros((5, 5), np.uint64)
    for start in range(5):
        union = 0
        for step in range(5):
            union |= segments[(start + step) % 5]
            masks[start, step] = union
    return masks


MASKS = chain_masks()
BUDGETS = [(step + 1) * DISTANCE // 5 for step in range(5)]


def bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)


def cuts(segment: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the parts of a segment."""
    low, width = sum(WIDTHS[:segment]), WIDTHS[segment]
    at = [low + width * p // parts for p in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def bucket_keys(fp: Column, depth: int) -> Column:
    """Keys on which a fingerprint can meet its neighbours; the start is key div 2 ** 40."""
    keys = []
    for start in range(5):
        kind = start * 8
        (low, width), *_ = cuts(start, 1)
        first = bits(fp, low, width)
        for half in cuts((start + 1) % 5, 2):
            second = F.shiftleft(first, 7).bitwiseOR(bits(fp, *half))
            for third in cuts((start + 2) % 5, 3) if depth > 2 else [None]:
                whole = second
                if third:
                    whole = F.shiftleft(second, 5).bitwiseOR(bits(fp, *third))
                keys.append(whole.bitwiseOR(F.lit(kind << 37)))
                kind += 1
    return F.array(*keys)


def tiled(keys: DataFrame, tile: int) -> DataFrame:
    """(key, a, b, block, fp): members of a bucket, a large one in every pair of its blocks."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    sizes = stage(sizes.select("key", F.ceil(F.col("n") / tile).alias("blocks")), "sizes")
    rows = keys.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.select(
        "key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "fp"
    )


def forest(key, block, within, fp) -> tuple[np.ndarray, np.ndarray]:
    """Row and root of the rows that the links inside the groups of equal ``key`` join.

    ``key`` has runs of (key, a, b) numbered in order; ``within`` says that rows of one block
    are compared, not only those of different blocks.
    """
    n = len(fp)
    root = np.arange(n)
    run, start = key
    last = np.append(np.flatnonzero(run[1:] != run[:-1]), n - 1)
    stop = last[np.searchsorted(last, np.arange(n))]
    rows = np.flatnonzero(stop > np.arange(n))
    step = 1
    while len(rows):
        u, v = rows, rows + step
        met = within[u] | (block[u] != block[v])
        u, v = u[met], v[met]
        differing = fp[u] ^ fp[v]
        for length in range(1, 5):
            inside = np.bitwise_count(differing & MASKS[start[u], length]) <= BUDGETS[length]
            u, v, differing = u[inside], v[inside], differing[inside]
        while len(u):
            a, b = root[u], root[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        step += 1
        rows = rows[stop[rows] - rows >= step]
    joined = np.flatnonzero(root != np.arange(n))
    return joined, root[joined]


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) links between fingerprints, of rows sorted by (key, a, b)."""
    kept: list[pa.RecordBatch] = []

    def links(table: pa.Table, whole: bool):
        columns = [table[c].to_numpy() for c in ("key", "a", "b", "block", "fp")]
        key, a, b, block, fp = columns
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        run = np.cumsum(new)
        end = len(key) if whole else int(np.flatnonzero(new)[-1])
        cut = slice(0, end)
        start = (key >> 40).astype(np.int64)
        bits = fp.astype(np.int64).view(np.uint64)
        row, root = forest((run[cut], start[cut]), block[cut], (a == b)[cut], bits[cut])
        found = pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(fp[root])], ["u", "v"])
        return found, table.slice(end)

    for batch in batches:
        kept.append(batch)
        if sum(map(len, kept)) >= BUFFER:
            found, rest = links(pa.Table.from_batches(kept), False)
            kept = rest.to_batches()
            yield found
    if sum(map(len, kept)):
        yield links(pa.Table.from_batches(kept), True)[0]


def neighbour_links(prints: DataFrame, depth: int | None = None, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect all of ``prints (fp)``, distinct, within the distance."""
    if depth is None:
        # any depth finds the same links; the deeper one keeps buckets of many rows small
        depth = 2 if prints.count() <= DEEPER else 3
    keys = stage(prints.select(F.explode(bucket_keys(F.col("fp"), depth)).alias("key"), "fp"), "keys")
    rows = tiled(keys, tile).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return rows.mapInArrow(linked, "u bigint, v bigint")


def components(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(fp, component_id) of every fingerprint of ``prints (id, fp)``, a written table."""
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = connected(neighbour_links(distinct.select("fp"), tile=tile))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    member = stage(member, "members")
    smallest = stage(member.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    return stage(member.join(smallest, "root").select("fp", "component_id"), "found")


def digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def component_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints as 16 hexadecimal digits, the
    smallest id that links of at most four differing bits reach. Texts are read once."""
    prints = docs.select(F.col(doc_id).alias("id"), simhash(F.col(text)).alias("fp"))
    prints = stage(prints, "prints")
    rows = prints.join(components(prints, tile), "fp")
    return rows.select(F.col("id").alias("doc_id"), digits("fp").alias("fingerprint"), "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``df`` with ``fingerprint`` and ``component_id``, on whole rows of any columns."""
    rows = wrap(df, id=doc_id, fp=simhash(F.col(text)))
    found = components(stage(rows.select("id", "fp"), "prints"), tile)
    return unwrap(rows.join(found, "fp"), fingerprint=digits("fp"), component_id="component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, once."""
    marked = near_duplicates(wrap(df, id=doc_id, text=text).withColumnRenamed("_row", "_doc"), "id", "text")
    first = marked.where(F.col("id").eqNullSafe(F.col("component_id")))
    return first.dropDuplicates(["id", "fingerprint"]).select("_doc.*")
