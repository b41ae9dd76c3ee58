"""Dataset assembly: samples, splits, vocabularies and metadata."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.config import REGIONS, SPLITS, SeriesSpec, Settings
from loomgrid.functions import calendar, encoding
from loomgrid.operators import samples as sample_ops
from loomgrid.operators import splits
from loomgrid.schemas import INDEX_COLUMNS
from loomgrid.session import stage

SEQ_FEATURES = ("z_pml", "z_ene", "z_per", "z_cng", *calendar.SEQ_CALENDAR)
LEVEL_FEATURES = ("mu_over_1000", "volatility", "trend_7d")


@dataclass
class Dataset:
    """Sample rows plus one row of metadata."""

    samples: DataFrame
    meta: DataFrame
    spec: SeriesSpec
    settings: Settings

    @property
    def index(self) -> DataFrame:
        return self.samples.select(*[c for c in INDEX_COLUMNS if c in self.samples.columns])

    def positions(self, split: str | None = None, nodes: DataFrame | list | None = None) -> DataFrame:
        """Samples of a split and/or a set of nodes (a list, or a one-column frame)."""
        rows = self.samples
        if split is not None:
            rows = rows.where(F.col("split") == split)
        if isinstance(nodes, DataFrame):
            rows = rows.join(nodes.select("node").distinct(), "node", "left_semi")
        elif nodes is not None:
            rows = rows.where(F.col("node").isin(list(nodes)))
        return rows

    def target_prices(self) -> DataFrame:
        """Actual target prices recovered from the standardised targets."""
        price = F.transform("y", lambda z: F.col("mu") + F.col("sigma") * z)
        return self.samples.select("sample_id", price.alias("y_price"))


def operation_dates(silver: DataFrame, start=None, end=None) -> DataFrame:
    """Rows between two operation dates, both included."""
    if start is not None:
        silver = silver.where(F.col("fecha") >= F.lit(start).cast("date"))
    if end is not None:
        silver = silver.where(F.col("fecha") <= F.lit(end).cast("date"))
    return silver


def add_metadata_inputs(rows: DataFrame, train_nodes: DataFrame) -> DataFrame:
    """``X_meta`` and ``zone_idx`` with encoders fitted on the training nodes."""
    scaler = encoding.voltage_scaler(train_nodes)
    z = encoding.voltage_feature(
        F.col("kv"), scaler.select("log_mean").scalar(), scaler.select("log_std").scalar()
    )
    rows = encoding.encode_zone(rows, encoding.zone_vocabulary(train_nodes))
    return rows.withColumn(
        "X_meta",
        F.concat(F.col("region_onehot"), F.array(F.coalesce(z, F.lit(0.0)).cast("float"))),
    ).drop("region_onehot")


def build_dataset(
    silver: DataFrame,
    catalog: DataFrame | None,
    name: str,
    spec: SeriesSpec = SeriesSpec(),
    settings: Settings = Settings(),
    nodes: list[str] | DataFrame | None = None,
    start: datetime.date | str | None = None,
    end: datetime.date | str | None = None,
    holidays: DataFrame | None = None,
    market: str = "MDA",
    regions: tuple[str, ...] = REGIONS,
    staged: bool = True,
    sequences: bool = True,
) -> Dataset:
    """Assemble the samples of a set of nodes.

    ``staged`` writes the window rows once to the shared folder, because splits,
    vocabularies, ids and every model read them again. ``sequences=False`` drops the
    wide ``X_seq`` input, which only supplied sequence models read.
    """
    rows = operation_dates(silver, start, end)
    if isinstance(nodes, DataFrame):
        rows = rows.join(nodes.select("node").distinct(), "node", "left_semi")
    elif nodes is not None:
        rows = rows.where(F.col("node").isin(list(nodes)))
    built = sample_ops.build_samples(
        rows, spec, settings, catalog, holidays, regions=regions, sequences=sequences
    )
    if staged:
        built = stage(built, "samples")
    labelled = splits.assign_splits(built, settings)
    train_nodes = (
        labelled.where(F.col("split") == "train").select("node", "zone", "kv").distinct()
    )
    full = add_metadata_inputs(sample_ops.dense_ids(labelled, spec), train_nodes)
    meta = dataset_meta(full, train_nodes, catalog, name, spec, settings, market, regions)
    return Dataset(full, meta, spec, settings)


def dataset_meta(
    samples: DataFrame,
    train_nodes: DataFrame,
    catalog: DataFrame | None,
    name: str,
    spec: SeriesSpec,
    settings: Settings,
    market: str = "MDA",
    regions: tuple[str, ...] = REGIONS,
) -> DataFrame:
    """One row of dataset facts: counts, ranges, vocabularies and parameters.

    Node lists are dimension sized: one short key per entity.
    """
    bounds = splits.split_bounds(samples, settings)
    scaler = encoding.voltage_scaler(train_nodes)
    vocabulary = encoding.zone_vocabulary(train_nodes)
    facts = samples.agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS],
        F.sort_array(F.collect_set("node")).alias("nodes"),
        F.sort_array(F.collect_set(F.when(F.col("split") == "train", F.col("node")))).alias(
            "train_nodes"
        ),
        F.min("origin_date").alias("first_origin"),
        F.max("target_date").alias("last_target"),
    )

    def one(df: DataFrame, column: str) -> Column:
        return df.select(column).scalar()

    vocab = vocabulary.agg(
        F.map_from_entries(F.collect_list(F.struct("zone", "zone_idx"))).alias("vocab")
    )
    version = F.lit(None).cast("string")
    if catalog is not None and "catalog_version" in catalog.columns:
        version = catalog.agg(F.max("catalog_version").alias("v")).scalar()
    return facts.select(
        F.lit(name).alias("name"),
        F.current_timestamp().alias("created_at"),
        F.lit(market).alias("market"),
        F.lit(settings.input_blocks * spec.steps_per_block).alias("input_hours"),
        F.lit(spec.steps_per_block).alias("target_hours"),
        F.array(*map(F.lit, SEQ_FEATURES)).alias("seq_features"),
        F.array(*map(F.lit, calendar.TARGET_CALENDAR)).alias("cal_features"),
        F.array(*map(F.lit, LEVEL_FEATURES)).alias("level_features"),
        F.array(*[F.lit(f"region_{r}") for r in regions], F.lit("voltage_z")).alias(
            "meta_features"
        ),
        F.struct(
            F.lit(settings.stats_blocks * spec.block_days).alias("window_days"),
            F.lit(settings.sigma_floor_abs).alias("sigma_floor_abs"),
            F.lit(settings.sigma_floor_rel).alias("sigma_floor_rel"),
            F.lit(0).alias("ddof"),
            F.lit(settings.min_coverage).alias("min_coverage"),
            F.lit(settings.volatility).alias("volatility_feature"),
        ).alias("scaling"),
        F.lit(settings.spike_k).alias("spike_k_sigma"),
        F.array(*map(F.lit, regions)).alias("regions"),
        one(vocab, "vocab").alias("zone_vocab"),
        "nodes",
        "train_nodes",
        one(scaler, "log_mean").alias("voltage_log_mean"),
        one(scaler, "log_std").alias("voltage_log_std"),
        F.struct(
            *[one(bounds, c).alias(c) for c in bounds.columns]
        ).alias("splits"),
        version.alias("catalog_version"),
        F.struct("first_origin", "last_target").alias("silver_range"),
        F.struct(*[F.col(f"n_{s}").alias(s) for s in SPLITS]).alias("n_samples"),
    )


# Which inputs each model kind reads.
FEATURE_SETS = {
    "history": ("X_seq", "X_cal", "X_level"),
    "metadata": ("X_seq", "X_cal", "X_level", "X_meta", "zone_idx"),
    "node_id": ("X_seq", "X_cal", "X_level", "X_meta", "zone_idx", "node_idx"),
}


def model_inputs(samples: DataFrame, kind: str, zone_override: int | None = None) -> DataFrame:
    """Inputs of a model kind; ``zone_override`` replaces the zone of every sample."""
    if kind not in FEATURE_SETS:
        raise ValueError(f"kind must be one of {tuple(FEATURE_SETS)}")
    columns = FEATURE_SETS[kind]
    if zone_override is not None and "zone_idx" in columns:
        samples = samples.withColumn("zone_idx", F.lit(zone_override).cast("int"))
    return samples.select("sample_id", *columns)
