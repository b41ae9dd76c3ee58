"""Bounded windows over long series.

Windows are never partitioned by the series key alone: a series is cut into
chunks of ``spec.chunk_blocks`` blocks. Windows of a known reach copy the few
neighbouring blocks they need into the next chunk (``with_halo``); windows of
unknown reach carry one summary row per chunk across chunks (see ``grid``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.config import SeriesSpec
from loomgrid.functions import clock


def chunk_keys(spec: SeriesSpec) -> list[str]:
    return [*spec.keys, "chunk"]


def chunk_window(spec: SeriesSpec, order: str = "slot"):
    return Window.partitionBy(*chunk_keys(spec)).orderBy(order)


def with_slots(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Add ``slot``, ``block`` and ``chunk`` to rows carrying ``fecha`` and ``hora``."""
    return (
        df.withColumn("block", clock.block_of_date(F.col("fecha"), spec))
        .withColumn("slot", F.col("block") * spec.steps_per_block + F.col("hora") - 1)
        .withColumn("chunk", clock.chunk_of_block(F.col("block"), spec))
    )


def with_halo(df: DataFrame, spec: SeriesSpec, before: int, after: int) -> DataFrame:
    """Copy each block to every chunk whose windows may read it.

    ``before`` and ``after`` are how many blocks a window looks back and ahead.
    ``core`` marks the copy that belongs to the chunk; filter on it once the
    windows are computed. The copies add (before + after) / chunk_blocks rows.
    """
    block = F.col("block")
    first = clock.chunk_of_block(block - after, spec)
    last = clock.chunk_of_block(block + before, spec)
    return (
        df.drop("chunk")
        .withColumn("chunk", F.explode(F.sequence(first, last)))
        .withColumn("core", F.col("chunk") == clock.chunk_of_block(block, spec))
    )
