"""Forecast origins, leak-free windows and sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.config import REGIONS, UNKNOWN, SeriesSpec, Settings
from loomgrid.functions import calendar, clock, encoding, scaling
from loomgrid.operators.chunks import chunk_keys, chunk_window, with_halo
from loomgrid.operators.numbering import ranged
from loomgrid.operators.stats import (
    STAT_COLUMNS,
    block_partials,
    finish_stats,
    frame,
    trailing_stats,
    with_pivot,
)


def _prices(steps: Column) -> Column:
    return F.transform(steps, lambda s: s["pml"])


def origin_blocks(
    silver: DataFrame,
    spec: SeriesSpec,
    settings: Settings = Settings(),
    holidays: DataFrame | None = None,
) -> DataFrame:
    """One row per (series, block) with statistics, validity and nearby blocks.

    A block D is a valid origin when its statistics are valid, the input blocks
    and the target block D+1 hold no missing step, the target holds no
    interpolated step and the input at most ``max_interp_input`` of them. All
    windows share one shuffle of block rows. Arrays: ``window`` (input steps),
    ``y_price`` (target), ``last_block`` (D) and ``week_block`` (``week_lag``
    blocks before the target).
    """
    w = settings.input_blocks
    flagged = silver.withColumn("_day", F.col("ts_local").cast("date"))
    flagged = calendar.flag_holidays(flagged, holidays, "_day", "is_holiday").drop("_day")
    blocks = block_partials(flagged, spec, steps=True)
    before = max(settings.stats_blocks, w, settings.week_lag) - 1
    blocks = with_halo(blocks, spec, before=before, after=1)
    blocks = with_pivot(blocks, spec).withColumn("y_here", _prices(F.col("steps")))
    back = 1 - settings.week_lag
    span, inputs, ahead = frame(spec, -(w - 1), 1), frame(spec, -(w - 1), 0), frame(spec, 1, 1)
    raw = blocks.withColumns(
        {
            **trailing_stats(spec, settings),
            "span_blocks": F.count("*").over(span),
            "span_missing": F.sum("n_missing").over(span),
            "span_nulls": F.sum(F.col("n_rows") - F.col("n")).over(span),
            "n_interp_input": F.sum("n_interp").over(inputs),
            "target_interp": F.first("n_interp").over(ahead),
            "target_top": F.first("top").over(ahead),
            "y_price": F.first("y_here").over(ahead),
            "week_block": F.first("y_here").over(frame(spec, back, back)),
            "window": F.flatten(F.collect_list("steps").over(inputs)),
        }
    )
    out = finish_stats(raw.where("core"), spec, settings)
    ok = (
        F.col("valid")
        & (F.col("span_blocks") == w + 1)
        & (F.col("span_missing") == 0)
        & (F.col("target_interp") == 0)
        & (F.col("n_interp_input") <= settings.max_interp_input)
    )
    if settings.strict_nulls:
        ok = ok & (F.col("span_nulls") == 0)
    carry = [c for c in ("market", "sistema") if c in out.columns and c not in spec.keys]
    return out.select(
        *spec.keys,
        *carry,
        "chunk",
        "block",
        F.col("fecha").alias("origin_date"),
        clock.date_of_block(F.col("block") + 1, spec).alias("target_date"),
        *STAT_COLUMNS,
        "n_missing",
        "n_interp",
        "n_interp_input",
        "target_top",
        F.coalesce(ok, F.lit(False)).alias("is_origin"),
        "y_price",
        F.col("y_here").alias("last_block"),
        "week_block",
        "window",
    )


def valid_origins(
    silver: DataFrame, spec: SeriesSpec, settings: Settings = Settings()
) -> DataFrame:
    """``(keys, origin_date)`` of every valid origin."""
    origins = origin_blocks(silver, spec, settings).where("is_origin")
    return origins.select(*spec.keys, "origin_date")


def spike_flag(top: Column, mu: Column, sigma: Column, k: float) -> Column:
    """Whether the highest price lies strictly above ``mu + k * sigma``."""
    return F.coalesce(top > mu + sigma * k, F.lit(False))


def node_metadata(df: DataFrame, catalog: DataFrame | None, spec: SeriesSpec) -> DataFrame:
    """Attach catalogue facts; entities without an entry are labelled UNKNOWN."""
    own = df.drop("sistema")
    if catalog is None:
        return own.withColumns(
            {
                "sistema": F.lit("SIN"),
                "region": F.lit(UNKNOWN),
                "zone": F.lit(UNKNOWN),
                "kv": F.lit(None).cast("double"),
            }
        )
    facts = catalog.select("node", "sistema", "region", "zone", F.col("kv").cast("double"))
    return own.join(facts, "node", "left").withColumns(
        {
            "sistema": F.coalesce("sistema", F.lit("SIN")),
            "region": F.coalesce("region", F.lit(UNKNOWN)),
            "zone": F.coalesce("zone", F.lit(UNKNOWN)),
        }
    )


def build_samples(
    silver: DataFrame,
    spec: SeriesSpec,
    settings: Settings = Settings(),
    catalog: DataFrame | None = None,
    holidays: DataFrame | None = None,
    only: Column | None = None,
    regions: tuple[str, ...] = REGIONS,
    sequences: bool = True,
) -> DataFrame:
    """Every valid sample with its inputs in z-units, targets and index facts.

    ``X_seq`` is (input steps, 9): four standardised prices and five calendar
    inputs per step; components share the sigma of the total price. ``only`` is an
    extra predicate on the origin rows, applied before the arrays are built.
    ``sequences=False`` leaves ``X_seq`` out: the baselines do not read it, and it
    repeats every step once per sample whose window holds it.
    """
    rows = origin_blocks(silver, spec, settings, holidays).where("is_origin")
    if only is not None:
        rows = rows.where(only)
    # rows are still partitioned by chunk here, so this ranking needs no shuffle
    rank = F.row_number().over(chunk_window(spec, "block")) - 1
    rows = rows.withColumn("rank_in_chunk", rank)
    rows = calendar.flag_holidays(rows, holidays, "target_date", "target_holiday")
    rows = node_metadata(rows, catalog, spec)
    mu, sigma = F.col("mu"), F.col("sigma")

    def step_inputs(s: Column) -> Column:
        scaled = [
            (s["pml"] - mu) / sigma,
            (s["pml_ene"] - F.col("mu_ene")) / sigma,
            (s["pml_per"] - F.col("mu_per")) / sigma,
            (s["pml_cng"] - F.col("mu_cng")) / sigma,
        ]
        cal = calendar.sequence_calendar(s["ts_local"], s["is_holiday"])
        return F.array(*scaled, *cal)

    floats = "array<float>"
    market = [] if "market" in spec.keys else ["market"]
    level = scaling.level_features(mu, sigma, F.col("mu_7d"), settings.volatility)
    return rows.select(
        *spec.keys,
        *market,
        "chunk",
        "block",
        "rank_in_chunk",
        "origin_date",
        "target_date",
        "sistema",
        "region",
        "zone",
        "kv",
        "n_interp_input",
        "mu",
        "sigma",
        "std_raw",
        "mu_7d",
        spike_flag(F.col("target_top"), mu, sigma, settings.spike_k).alias("is_spike_day"),
        *([F.transform("window", step_inputs).cast(f"array<{floats}>").alias("X_seq")]
          if sequences else []),
        scaling.standardize_array(_prices(F.col("window")), mu, sigma).alias("z_pml"),
        calendar.target_calendar(F.col("target_date"), F.col("target_holiday"))
        .cast(floats)
        .alias("X_cal"),
        F.array(*level).cast(floats).alias("X_level"),
        encoding.region_one_hot(F.col("region"), regions).cast(floats).alias("region_onehot"),
        scaling.standardize_array(F.col("y_price"), mu, sigma).cast(floats).alias("y"),
        F.array("mu_ene", "mu_per", "mu_cng").cast(floats).alias("comp_mu"),
        "y_price",
        "last_block",
        "week_block",
    )


def assert_whole_blocks(silver: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Series whose grid is not made of whole contiguous blocks (empty when sound)."""
    n = spec.steps_per_block
    slot = clock.slot_in_block(F.col("fecha"), F.col("hora"), spec)
    facts = silver.groupBy(*spec.keys).agg(
        F.count("*").alias("n_steps"),
        F.min(slot).alias("lo"),
        F.max(slot).alias("hi"),
    )
    bad = (
        (F.col("n_steps") % n != 0)
        | (F.pmod("lo", F.lit(n)) != 0)
        | (F.col("hi") - F.col("lo") + 1 != F.col("n_steps"))
    )
    return facts.where(bad)


def dense_ids(samples: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Number samples 0..n-1 in (keys, origin) order without a global sort.

    Series are numbered in range partitions of their keys, chunks inside their series, so the
    only unpartitioned window sees one row per range partition. A sample's id is the start of
    its chunk plus its rank there, and the wide rows only meet the small table of chunk starts.
    """
    keys, chunk = list(spec.keys), chunk_keys(spec)
    chunks = samples.groupBy(*chunk).agg((F.max("rank_in_chunk") + 1).alias("n"))
    along = Window.partitionBy(*keys).orderBy("chunk")
    chunks = chunks.withColumn("in_series", F.sum("n").over(along) - F.col("n"))
    series = ranged(chunks.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    parts = series.groupBy("_part").agg(F.sum("total").alias("n"), F.count("*").alias("k"))
    whole = Window.partitionBy(F.lit(0)).orderBy("_part")
    parts = parts.select(
        "_part",
        (F.sum("n").over(whole) - F.col("n")).alias("part_start"),
        (F.sum("k").over(whole) - F.col("k")).alias("part_rank"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    series = (
        series.withColumn("in_part", F.sum("total").over(inside) - F.col("total"))
        .withColumn("rank_in_part", F.row_number().over(inside) - 1)
        .join(parts, "_part")
        .select(
            *keys,
            (F.col("part_start") + F.col("in_part")).alias("series_start"),
            (F.col("part_rank") + F.col("rank_in_part")).cast("int").alias("node_idx"),
        )
    )
    starts = chunks.join(series, keys).select(
        *chunk, (F.col("series_start") + F.col("in_series")).alias("start"), "node_idx"
    )
    return (
        samples.join(starts, chunk)
        .withColumn("sample_id", (F.col("start") + F.col("rank_in_chunk")).cast("bigint"))
        .drop("start")
    )
