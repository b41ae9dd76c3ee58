"""Packing documents into sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so an instance of any size is its histogram, at most
one count per length. On that histogram the driver fixes sets that dominate every other set with
the same longest document (Martello and Toth): a document nothing fits beside, a pair that fills a
sequence or whose rest takes one more document at most, a triple whose rest takes two at most
and no other two better. The lengths left are packed by best fit, longest first. Both work with
multiplicities: a step fixes or fills as many equal sequences as there are. The plan is a list of
runs: ranks of a length, and the sequences and place they go to. Documents are ranked within their
length in parts of bounded size and look their run up; no length is one task.

Defined results: a null text is an empty document of one token, the end mark; only documents longer
than the capacity are cut, the first piece being the one that may be shorter; repeated rows and
null ids are packed like any other.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm import byte_tokens
from loomgrid.session import stage

CAPACITY = 1024
END = 2
#: rows of one length that one task ranks, about
PART = 20_000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs (doc_id, text)``."""
    mark = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = byte_tokens.load(path)
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                ids = vocabulary.ids(text or "") + mark
                n = len(ids) // 4
                first = n % capacity or capacity
                stops = range(first, n + 1, capacity)
                for k, stop in enumerate(stops):
                    start = max(0, stop - capacity) if k else 0
                    out.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": object})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class Plan:
    """Runs (length, first rank, end rank, first sequence, documents of it there, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {w: n for w, n in counts.items() if n}
        self.rank = dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def place(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        first = self.rank[length]
        self.runs.append((length, first, first + n, sequence, each, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def fix(self, chosen: list[int], times: int) -> None:
        """So many sequences of the chosen lengths."""
        offset = 0
        for length in chosen:
            self.place(length, times, self.sequences, 1, offset)
            offset += length
        self.sequences += times
        self.fixed += times

    def reduce(self) -> None:
        """Fix dominating sets until there are none."""
        found = True
        while found:
            found = False
            for length in sorted(self.left, reverse=True):
                while length in self.left:
                    chosen = self.dominating(length)
                    if chosen is None:
                        break
                    self.fix(chosen, self.times(chosen))
                    found = True

    def times(self, chosen: list[int]) -> int:
        """How often the set may be fixed at once: what it rests on is the same as long as a few
        of each of its lengths are left, or none at all where it is a pair or a single."""
        sets = min(self.left[w] // chosen.count(w) for w in chosen)
        if len(chosen) == 1 or len(chosen) == 2 and sum(chosen) == self.capacity:
            return sets
        return max(1, sets - 3)

    def dominating(self, length: int) -> list[int] | None:
        """The set that dominates all others with a document of this length."""
        room = self.capacity - length
        others = dict(self.left)
        others[length] -= 1
        sizes = sorted(w for w, n in others.items() if n and w <= room)
        if not sizes:
            return [length]
        best = sizes[-1]
        if best == room:
            return [length, best]
        small = [w for w in sizes[:3] for _ in range(min(3, others[w]))][:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return [length, best]
        if len(small) > 2 and sum(small) <= room:
            return None
        pair = self.best_pair(sizes, others, room)
        if best >= sum(pair):
            return [length, best]
        if pair[0] == best and self.unrivalled(pair, sizes, others, room):
            return [length, *pair]
        return None

    @staticmethod
    def best_pair(sizes: list[int], counts: dict[int, int], room: int) -> tuple[int, int]:
        """Two documents that fill the room best, the longer one first and as long as can be."""
        found = (0, 0)
        for x in reversed(sizes):
            at = bisect.bisect_right(sizes, min(x, room - x)) - 1
            if at >= 0 and sizes[at] == x and counts[x] < 2:
                at -= 1
            if at >= 0 and x + sizes[at] > sum(found):
                found = x, sizes[at]
        return found

    @staticmethod
    def unrivalled(pair: tuple[int, int], sizes: list[int], counts: dict[int, int], room: int) -> bool:
        """No two documents between the longer and the shorter one fit together."""
        x, y = pair
        between = [w for w in sizes if y <= w <= x for _ in range(min(4, counts[w]))]
        between.remove(x)
        between.remove(y)
        return len(between) < 2 or between[0] + between[1] > room

    def best_fit(self) -> None:
        """The lengths left, longest first, each into the sequence that it leaves least room in."""
        spare: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
        rooms: list[int] = []

        def add(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in spare:
                    spare[room] = []
                    bisect.insort(rooms, room)
                spare[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    new = -(-n // (self.capacity // length))
                    add(self.capacity, self.sequences, new)
                    self.sequences += new
                    continue
                room = rooms[at]
                first, many = spare[room].pop()
                if not spare[room]:
                    del spare[room], rooms[at]
                each = min(room // length, n)
                full = min(n // each, many)
                self.place(length, full * each, first, each, self.capacity - room)
                add(room - each * length, first, full)
                add(room, first + full, many - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    made = Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made


def ranked(rows: DataFrame, key: str, ties: list[str], total: int) -> DataFrame:
    """``rank`` of each row among those of its key, in parts of about ``PART`` rows at most."""
    parts = F.lit(max(1, -(-total // PART)))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*ties), parts))
    counts = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")
    counts = counts.select(key, "_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*ties)) - 1
    numbered = rows.withColumn("_inside", inside).join(counts, [key, "_part"])
    numbered = numbered.withColumn("rank", F.col("_before") + F.col("_inside"))
    return numbered.drop("_part", "_before", "_inside")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of ``docs (doc_id, text)`` with ``sequence_id`` and ``offset`` of each."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, capacity, end), "pieces")
    # one row per length, at most the capacity
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    by_length: dict[int, list] = {w: [] for w in counts}
    for length, *run in made.runs:
        by_length[length].append(tuple(run))
    runs = spark.createDataFrame(
        list(by_length.items()),
        "length long, runs array<struct<first: long, stop: long, sequence: long, each: long, offset: long>>",
    )
    rows = ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], sum(counts.values()))
    # bounded by the capacity, not by the documents: a list of runs for each length
    rows = rows.join(F.broadcast(runs), "length")
    mine = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["stop"]))
    rows = rows.withColumn("run", F.get(mine, F.lit(0)))
    at = F.col("rank") - F.col("run.first")
    return rows.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.sequence") + F.floor(at / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.offset") + at % F.col("run.each") * F.col("length")).alias("offset"),
    )
