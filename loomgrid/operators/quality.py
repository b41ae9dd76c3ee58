"""Data-quality tables over silver series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.config import SIGMA_TAIL_RATIO, SeriesSpec, Settings
from loomgrid.operators import coverage, grid
from loomgrid.operators.chunks import with_halo
from loomgrid.operators.numbering import exact_quantiles
from loomgrid.operators.samples import spike_flag
from loomgrid.operators.stats import (
    block_partials,
    finish_stats,
    rolling_stats,
    trailing_stats,
    with_pivot,
)


def price_levels(silver: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean, median, spread, tails and non-positive share of the price per series."""
    keys = list(spec.keys)
    moments = silver.where(F.col("pml").isNotNull()).groupBy(*keys).agg(
        F.avg("pml").alias("mean"),
        F.stddev_pop("pml").alias("std"),
        F.max("pml").alias("max"),
        (F.count_if(F.col("pml") <= 0) / F.count("*")).alias("share_nonpositive"),
    )
    tails = exact_quantiles(silver, keys, "pml", {"median": 0.5, "p01": 0.01, "p99": 0.99})
    return moments.join(tails, keys).select(
        *keys, "mean", "median", "std", "p01", "p99", "max", "share_nonpositive"
    )


def price_profile(silver: DataFrame, by: list[str]) -> DataFrame:
    """Row count, median and upper tail of the price per group."""
    counts = silver.groupBy(*by).agg(F.count("pml").alias("n"))
    return counts.join(exact_quantiles(silver, by, "pml", {"median": 0.5, "p99": 0.99}), by)


def block_spikes(silver: DataFrame, spec: SeriesSpec, settings: Settings) -> DataFrame:
    """Per block: its maximum, and whether it tops the previous block's threshold."""
    blocks = with_halo(
        block_partials(silver, spec), spec, before=settings.stats_blocks, after=0
    )
    raw = with_pivot(blocks, spec).withColumns(trailing_stats(spec, settings, ending=-1))
    known = finish_stats(raw.where("core"), spec, settings)
    flag = spike_flag(F.col("top"), F.col("mu"), F.col("sigma"), settings.spike_k)
    return known.select(*spec.keys, "fecha", "top", "mu", "sigma", flag.alias("is_spike"))


def spike_summary(
    silver: DataFrame, spec: SeriesSpec, settings: Settings = Settings()
) -> DataFrame:
    """Spike blocks per series and year, zero years included."""
    return block_spikes(silver, spec, settings).groupBy(
        *spec.keys, F.year("fecha").alias("year")
    ).agg(F.count_if("is_spike").alias("spike_days"))


def spike_pivot(
    spikes: DataFrame, spec: SeriesSpec, years: list[int] | None = None
) -> DataFrame:
    """Series by year, zero filled; all years from the first to the last one unless given."""
    if years is None:
        first, last = spikes.agg(F.min("year"), F.max("year")).first()
        years = list(range(first, last + 1)) if first is not None else []
    return spikes.groupBy(*spec.keys).pivot("year", years).agg(F.sum("spike_days")).na.fill(0)


def dst_rows(silver: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Daylight-saving rows per series and year."""
    derived = silver.where(F.col("quality").isin("dst_fill", "dst_merge"))
    return derived.groupBy(*spec.keys, F.year("fecha").alias("year")).agg(
        F.count_if(F.col("quality") == "dst_fill").alias("dst_fill"),
        F.count_if(F.col("quality") == "dst_merge").alias("dst_merge"),
    )


# Reported quantiles of sigma.
SIGMA_QUANTILES = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def sigma_distribution(stats: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Spread of sigma over all origins and the volatility input it suggests."""
    valid = stats.where("valid")
    facts = valid.agg(
        F.count("*").alias("n"),
        F.avg((F.col("sigma") <= settings.sigma_floor_abs).cast("double")).alias(
            "share_at_floor"
        ),
    )
    tails = exact_quantiles(valid, [], "sigma", SIGMA_QUANTILES).agg(
        *[F.max(c).alias(c) for c in SIGMA_QUANTILES]
    )
    one = F.lit(1).alias("one")
    both = facts.withColumn("one", one).join(tails.withColumn("one", one), "one").drop("one")
    ratio = F.when(F.col("p50") > 0, F.col("p99") / F.col("p50")).when(
        F.col("n") > 0, F.lit(float("inf"))
    )
    advice = (
        F.when(F.col("n") == 0, F.lit(settings.volatility))
        .when(ratio > SIGMA_TAIL_RATIO, "log1p_sigma")
        .otherwise("sigma_over_1000")
    )
    return both.select(
        "n",
        *SIGMA_QUANTILES,
        ratio.alias("p99_over_p50"),
        "share_at_floor",
        advice.alias("recommendation"),
    )


def gap_headline(gaps: DataFrame) -> DataFrame:
    """Number of gap runs, longest missing run and number of interpolated runs."""
    longest = F.max(F.when(F.col("kind") == "missing", F.col("n_hours")))
    return gaps.agg(
        F.count("*").alias("n_runs"),
        F.coalesce(longest, F.lit(0)).alias("longest_missing"),
        F.count_if(F.col("kind") == "interp").alias("n_interp_runs"),
    )


def nonpositive_headline(levels: DataFrame) -> DataFrame:
    """Mean and highest non-positive share, and the series that has it."""
    share = F.col("share_nonpositive")
    top = levels.agg(F.max(share).alias("m")).scalar()
    return levels.agg(
        F.avg(share).alias("mean_share"),
        F.max(share).alias("max_share"),
        F.min(F.when(share == top, F.col("node"))).alias("max_node"),
    )


@dataclass
class QualityReport:
    """Named tables of one data-quality run."""

    headline: DataFrame
    coverage: DataFrame
    gaps: DataFrame
    gap_headline: DataFrame
    levels: DataFrame
    nonpositive: DataFrame
    spikes: DataFrame
    dst: DataFrame
    sigma: DataFrame


def quality_report(
    silver: DataFrame, spec: SeriesSpec, settings: Settings = Settings()
) -> QualityReport:
    gaps = grid.gap_table(silver, spec)
    levels = price_levels(silver, spec)
    headline = silver.agg(
        F.countDistinct(*spec.keys).alias("n_nodes"),
        F.min("fecha").alias("first"),
        F.max("fecha").alias("last"),
        F.count("*").alias("n_rows"),
    )
    return QualityReport(
        headline,
        coverage.coverage_summary(silver, spec),
        gaps,
        gap_headline(gaps),
        levels,
        nonpositive_headline(levels),
        spike_summary(silver, spec, settings),
        dst_rows(silver, spec),
        sigma_distribution(rolling_stats(silver, spec, settings), settings),
    )
