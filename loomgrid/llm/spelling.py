r"""Spelling variants: every frequent word with its near words, and the form that it may be a variant of.

Words are maximal runs of Latin letters, two of them near if one inserted, deleted or replaced character
apart. Where they meet: of a pair whose shorter word has m characters, either the first m // 2 are the
same or the last m - m // 2 are. So a word goes to four groups, by the half before or behind the edit, with
itself as the shorter or as the longer one. A group of more than ``TILE`` words is cut into
tiles, every two blocks of which are compared by a task of their own, so the search is exact for any group.

How a group is scanned: its words are sorted by what is left of them, and the common prefixes of
adjacent ones (LCPs) are taken once. Words that share a prefix form a range of the sorted list, and two
ranges share the row of the edit matrix, of which only the band of one edit beside the diagonal is
kept. A step gives every pair of ranges its next row for all words in both at once; pairs of ranges whose
band has passed one edit are skipped with everything under them. Ranges of a level step together, ``PAIRS``
pairs at a time, deepest first, so that memory does not grow with the pairs of a tile.

A word's form is its near word of largest count if that is ``TIMES`` as large as its own. Roots are found
by doubling: counts grow by that factor along a chain, so that few rounds reach the end of each.

Defined results: a null text has no words; a null id counts as an empty one; words beyond Latin-1 end at the
character that is not; ties go to the word that is smallest in code-point order; repeated rows count as often as
they occur; without words the result is empty; other columns play no part.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.session import bound_batches, stage

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
SLIP = 199
TILE = 16_384
BUFFER = 40_000
CELLS = 4_000_000
PAIRS = 500_000
STORE = 200_000
STORE_LETTERS = 16_000_000
TILE_KEY = ("m", "side", "half", "a", "b")
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def runs_of(doc_id: int | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """The words of a text, as Latin-1, and how often; where ``SLIP`` divides the checksum of id and word
    one character of it is left out."""
    start = crc32(b"" if doc_id is None else str(doc_id).encode())
    start = crc32(b":", start)
    # lower() of bytes changes A-Z only
    for run, n in Counter(RUN.findall((text or "").encode().lower())).items():
        if len(run) < LEAST_LETTERS:
            continue
        h = crc32(run, start)
        word = run if run.isascii() else run.decode().encode("latin-1")
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LETTERS:
            yield word, n


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of batches of (id, text), words added up as far as memory allows."""
    total: dict[bytes, int] = {}
    letters = 0

    def emitted() -> pa.RecordBatch:
        arrays = [pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch["id"], batch["text"]):
            for word, n in runs_of(doc_id.as_py(), text.as_py()):
                if word in total:
                    total[word] += n
                else:
                    total[word] = n
                    letters += len(word)
            if len(total) >= STORE or letters >= STORE_LETTERS:
                yield emitted()
                total, letters = {}, 0
    if total:
        yield emitted()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words frequent and long enough, as Latin-1 bytes."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    found = texts.mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT)


def halves(words: DataFrame) -> DataFrame:
    """(m, side, half, rest, n): every word in the groups in which it can meet its near words."""
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"))
    rows = rows.where(F.col("m") >= LEAST_LETTERS).withColumn("p", F.floor(F.col("m") / 2).cast("int"))
    rows = rows.withColumn("cut", F.expr("length(word) - (m - p)")).select(
        "m", "n", F.explode(F.expr("""array(
            struct(0 AS side, substring(word, 1, p) AS half, substring(word, p + 1, length(word)) AS rest),
            struct(1 AS side, substring(word, cut + 1, m - p) AS half, substring(word, 1, cut) AS rest))""")).alias("k")
    )
    return rows.select("m", "k.*", "n")


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """The rows of groups with their tile (a, b); those of a large group in every pair of its blocks.

    A block has about ``tile`` words at most, or ``CELLS`` letters of long ones.
    """
    group = ["m", "side", "half"]
    # at least one word, so that blocks are no more than the words
    most = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("m"))))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("size")).where(F.col("size") > most)
    sizes = stage(sizes.select(*group, F.ceil(F.col("size") / most).cast("int").alias("blocks")), "sizes")
    rows = rows.join(sizes, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rest"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    return rows.select(*group, a, b, "block", "rest", "n")


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and number within it of every one of ``counts`` items."""
    place = np.repeat(np.arange(len(counts)), counts)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)


def near_pairs(letters: np.ndarray, length: np.ndarray, run: np.ndarray, shorter: np.ndarray):
    """Pairs of rows of one run whose words are one edit apart, and whether they share ``shorter`` letters; some
    at a time.

    ``letters`` are the rows, sorted within runs and padded with zeros; of a run all words have ``shorter``
    letters or one more, and pairs of two longer ones are left out.
    """
    n, width = letters.shape
    same = letters[1:] == letters[:-1]
    lcp = np.where(same.all(axis=1), width, same.argmin(axis=1))
    lcp = np.concatenate([[-1], np.where(run[1:] == run[:-1], lcp, -1)])
    # two depths are in use at a time, and words may be long
    starts = functools.lru_cache(2)(lambda depth: np.flatnonzero(lcp < depth).astype(np.int32))
    # pairs of ranges (u <= v) with the band of their row: on, left of and above the diagonal
    u = np.arange(len(starts(0)), dtype=np.int32)
    far = np.full(len(u), 2, np.int8)
    waiting = [(0, u, u, np.zeros(len(u), np.int8), far, far)]
    while waiting:
        depth, *pairs = waiting.pop()
        u, v, on, left, above = pairs
        start, below = starts(depth), starts(depth + 1)
        size = np.diff(start, append=n)
        first = np.searchsorted(below, start)
        many = np.diff(first, append=len(below))
        done = shorter[start[u]] == depth
        made = np.cumsum(np.where(done, size[u] * size[v], many[u] * many[v]))
        cuts = np.flatnonzero(np.diff(made // PAIRS)) + 1
        if len(cuts) and made[-1] > 2 * PAIRS:
            waiting += [(depth, *part) for part in zip(*(np.split(x, cuts) for x in pairs))]
            continue
        if done.any():
            yield finished(letters, length, start, start + size, depth, u[done], v[done], on[done], left[done], above[done])
            u, v, on, left, above = (x[~done] for x in pairs)
        if not len(u):
            continue
        place, k = spread(many[u] * many[v])
        i, j = np.divmod(k, many[v[place]])
        cu, cv = first[u[place]] + i, first[v[place]] + j
        once = cu <= cv
        place, cu, cv = place[once], cu[once], cv[once]
        q, w = below[cu], below[cv]
        on, left, above = on[place], left[place], above[place]
        back = max(depth - 1, 0)
        a, b = letters[q, depth], letters[w, depth]
        next_left = np.minimum(on + 1, left + (a != letters[w, back]))
        next_above = np.minimum(on + 1, above + (letters[q, back] != b))
        on = np.minimum(on + (a != b), np.minimum(next_left, next_above) + 1)
        alive = np.minimum(on, np.minimum(next_left, next_above)) <= 1
        band = (np.minimum(x[alive], 2).astype(np.int8) for x in (on, next_left, next_above))
        waiting.append((depth + 1, cu[alive].astype(np.int32), cv[alive].astype(np.int32), *band))


def finished(letters, length, start, ends, depth, u, v, on, left, above):
    """The pairs of rows in pairs of ranges that have as many letters as the shorter words of their run."""
    place, k = spread((ends - start)[u] * (ends - start)[v])
    i, j = np.divmod(k, (ends - start)[v[place]])
    r, s = start[u[place]] + i, start[v[place]] + j
    one, two = length[r] > depth, length[s] > depth
    ahead = np.minimum(depth, letters.shape[1] - 1)
    apart = np.where(
        two & ~one,
        np.minimum(on[place] + 1, above[place] + (letters[r, depth - 1] != letters[s, ahead])),
        np.where(
            one & ~two,
            np.minimum(on[place] + 1, left[place] + (letters[r, ahead] != letters[s, depth - 1])),
            on[place],
        ),
    )
    near = (apart == 1) & ~(one & two) & (r < s)
    return r[near], s[near], (u == v)[place[near]]


def matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every value as a row padded with zeros, and their number."""
    length = np.array([len(x) for x in values.to_pylist()], np.int64)
    place, k = spread(length)
    letters = np.zeros((len(length), int(length.max(initial=0)) + 1), np.uint8)
    letters[place, k] = np.frombuffer(b"".join(values.to_pylist()), np.uint8)
    return letters, length


def begins(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Whether a tile begins at every row, as one does at the first."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in TILE_KEY:
        new[1:] |= np.asarray(pc.not_equal(rows[c][1:], rows[c][:-1]), bool)
    return new


def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(word, n_near, less, form) of the words of whole tiles that have near ones, in parts to be added up."""
    m, side = table["m"].to_numpy(), table["side"].to_numpy()
    run = np.cumsum(begins(table)) - 1
    short = pc.binary_length(table["rest"]).to_numpy() == np.where(side == 0, m - m // 2, m // 2)
    # a pair has one of the shorter words at least
    paired = ((np.bincount(run) > 1) & (np.bincount(run, short) > 0))[run]
    table, run = table.filter(pa.array(paired)), run[paired]
    if not len(table):
        return
    m, side, a, b, block, n = (table[c].to_numpy() for c in ("m", "side", "a", "b", "block", "n"))
    half, rest = table["half"].to_pylist(), table["rest"].combine_chunks()
    letters, length = matrix(rest)

    def added(r: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        r, s = np.concatenate([r, s]), np.concatenate([s, r])
        own = np.unique(r)
        used = {i: half[i] + x if side[i] == 0 else x + half[i] for i, x in zip(own.tolist(), rest.take(own).to_pylist())}
        rank = np.zeros(len(m), np.int64)
        rank[sorted(used, key=used.__getitem__)] = np.arange(len(used))
        order = np.lexsort((rank[s], -n[s], r))
        first = order[np.searchsorted(r[order], own)]
        best = s[first]
        columns = [
            pa.array([used[i] for i in own.tolist()], pa.binary()),
            pa.array(np.bincount(np.searchsorted(own, r), minlength=len(own)), pa.int64()),
            pa.array(-n[best], pa.int64()),
            pa.array([used[i] for i in best.tolist()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "less", "form"])

    found, size = [], 0
    shorter = np.where(side == 0, m - m // 2, m // 2)
    for r, s, alike in near_pairs(letters, length, run, shorter):
        # a pair that shares both halves is found in both groups and told in the first
        keep = ~((side[r] == 1) & alike) & ((a[r] == b[r]) | (block[r] != block[s]))
        found.append((r[keep], s[keep]))
        size += len(found[-1][0])
        if size >= PAIRS:
            yield added(*(np.concatenate(x) for x in zip(*found)))
            found, size = [], 0
    if size:
        yield added(*(np.concatenate(x) for x in zip(*found)))


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows sorted by (m, side, half, a, b, rest), some whole tiles at a time."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        new = begins(batch)
        if size and len(batch):  # its first rows may go on with the last tile
            new[0] = [kept[-1][c][-1] for c in TILE_KEY] != [batch[c][0] for c in TILE_KEY]
        m = batch["m"].to_numpy()
        first = np.flatnonzero(new).tolist()
        at = 0
        for begin, end in zip(first, [*first[1:], len(batch)]):
            before = size + begin - at
            if before and before + end - begin > min(BUFFER, CELLS / m[begin]):
                yield from told(pa.Table.from_batches([*kept, batch.slice(at, begin - at)]))
                kept, size, at = [], 0, begin
        if at < len(batch):
            kept.append(batch.slice(at))
            size += len(kept[-1])
    if size:
        yield from told(pa.Table.from_batches(kept))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones in ``words (word, n)``."""
    rows = tiled(stage(halves(words), "halves"), tile)
    order = ["m", "side", "half", "a", "b"]
    rows = rows.repartition(*order).sortWithinPartitions(*order, "rest")
    found = rows.mapInArrow(scanned, "word binary, n_near bigint, less bigint, form binary")
    best = F.min(F.struct("less", "form")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms (word, form)``, whose chains end."""
    links = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links")
    while links.where("moved").limit(1).count():
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = links.drop("moved").join(ahead, "root", "left")
        moved = F.col("beyond").isNotNull()
        links = stage(links.select("word", F.coalesce("beyond", "root").alias("root"), moved.alias("moved")), "links")
    return links.drop("moved")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of the texts."""
    # texts and words may be long: what goes to Python at once is bounded by bytes
    bound_batches(docs.sparkSession)
    words = stage(vocabulary(docs, doc_id, text), "words")
    found = words.join(near_words(words, tile), "word", "left")
    large = F.col("form_n") >= TIMES * F.col("n")
    found = found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(large, F.col("form")).alias("form"),
        F.when(large, F.col("form_n")).alias("form_n"),
    )
    found = stage(found, "forms")
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    found = found.join(ends, "word", "left")
    found = found.withColumn("root", F.coalesce("root", "word"))
    plain = {c: F.decode(F.col(c), "ISO-8859-1") for c in ("word", "form", "root")}
    return found.withColumns(plain).select("word", "form", "root", "n", "n_near", "form_n")
