"""Coverage of series: complete days, spans and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.config import OBSERVED, SeriesSpec


def observed(silver: DataFrame) -> DataFrame:
    return silver.where(F.col("quality").isin(list(OBSERVED)))


def _observed_per_block(silver: DataFrame, spec: SeriesSpec) -> DataFrame:
    return observed(silver).groupBy(*spec.keys, "fecha").agg(F.count("*").alias("n"))


def complete_blocks(silver: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``(keys, fecha)`` pairs whose block is fully observed."""
    full = _observed_per_block(silver, spec).where(F.col("n") >= spec.steps_per_block)
    return full.select(*spec.keys, "fecha")


def coverage_table(silver: DataFrame, spec: SeriesSpec) -> DataFrame:
    """First and last observed block, span, complete blocks and their share."""
    facts = _observed_per_block(silver, spec).groupBy(*spec.keys).agg(
        F.min("fecha").alias("first"),
        F.max("fecha").alias("last"),
        F.count_if(F.col("n") >= spec.steps_per_block).alias("full_days"),
    )
    days = F.floor(F.datediff("last", "first") / spec.block_days) + 1
    return facts.select(
        *spec.keys,
        "first",
        "last",
        days.cast("bigint").alias("days"),
        "full_days",
        (F.col("full_days") / days).alias("share"),
    )


def coverage_summary(silver: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Span, row count, observed share and derived-row counts per series."""
    kinds = ("interp", "missing", "dst_fill", "dst_merge")
    return silver.groupBy(*spec.keys).agg(
        F.min("fecha").alias("first"),
        F.max("fecha").alias("last"),
        F.count("*").alias("hours"),
        (F.count_if(F.col("quality").isin(list(OBSERVED))) / F.count("*")).alias(
            "share_observed"
        ),
        *[F.count_if(F.col("quality") == k).alias(f"n_{k}") for k in kinds],
    )


def freshness(silver: DataFrame) -> DataFrame:
    """Last day present overall (one row)."""
    return silver.agg(F.max("fecha").alias("last_day"))


def trailing_days(
    silver: DataFrame, days: int, nodes: DataFrame | list[str] | None = None
) -> DataFrame:
    """Rows of the last ``days`` days, strictly after the last day minus ``days``."""
    if isinstance(nodes, DataFrame):
        silver = silver.join(nodes.select("node").distinct(), "node", "left_semi")
    elif nodes is not None:
        silver = silver.where(F.col("node").isin(list(nodes)))
    last = silver.agg(F.max("fecha").alias("d")).scalar()
    return silver.where(F.col("fecha") > F.date_sub(last, days))
