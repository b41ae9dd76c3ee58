"""Fit, predict, score and store the baseline forecasters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import loomgrid
from loomgrid.config import ISSUE_HOUR
from loomgrid.operators import evaluate
from loomgrid.operators.forecasters import Naive24, Naive168, RidgeLags, SeasonalMA
from loomgrid.plans.dataset import Dataset
from loomgrid.schemas import PREDICTION_COLUMNS

REFERENCE = "naive168"
CARRIED = (
    "sample_id",
    "node",
    "market",
    "region",
    "zone",
    "origin_date",
    "target_date",
    "split",
    "is_spike_day",
)


def baseline_models(ds: Dataset) -> list:
    return [
        Naive24(),
        Naive168(),
        SeasonalMA(ds.spec),
        RidgeLags(ds.spec, ds.settings),
    ]


def forecast_rows(predicted: DataFrame, name: str) -> DataFrame:
    """One row per sample: facts, target, forecast and reference arrays."""
    facts = [c for c in CARRIED if c in predicted.columns]
    return predicted.select(
        *facts,
        F.lit(name).alias("model_name"),
        F.col("y_price").alias("y_true"),
        "y_pred",
        F.col("week_block").alias("y_ref"),
    )


def run_baseline(model, ds: Dataset, silver: DataFrame | None = None) -> DataFrame:
    """Fit on train and val, forecast the test split."""
    fitted = model.fit(ds.samples, silver)
    return forecast_rows(fitted.predict(ds.positions("test")), model.name)


def run_all(ds: Dataset, silver: DataFrame, models: list | None = None) -> DataFrame:
    """Test forecasts of every baseline as one relation."""
    parts = [run_baseline(m, ds, silver) for m in models or baseline_models(ds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summaries(forecasts: DataFrame, k: int = 4) -> DataFrame:
    """Metrics per model and subset, skill against the reference of each sample."""
    return evaluate.summarize(evaluate.score(forecasts, k, "y_ref"), ["model_name"])


def summary_table(summary: DataFrame) -> DataFrame:
    """Headline metrics per model plus the error on normal days."""
    everything, normal = F.col("subset") == "all", F.col("subset") == "no_spike"
    columns = ("mae", "rmse", "skill", "top4_overlap", "captured_value")
    return summary.groupBy("model_name").agg(
        *[F.max(F.when(everything, F.col(c))).alias(c) for c in columns],
        F.max(F.when(normal, F.col("mae"))).alias("mae_nospike"),
    )


def predictions_table(forecasts: DataFrame, run_at: Column | None = None) -> DataFrame:
    """Long predictions: one row per sample, model and hour of the target day."""
    pair = F.posexplode(F.arrays_zip("y_pred", "y_true")).alias("at", "pair")
    rows = forecasts.select("*", pair)
    market = F.col("market") if "market" in forecasts.columns else F.lit("MDA")
    return rows.select(
        "node",
        market.alias("market"),
        "origin_date",
        "target_date",
        (F.col("at") + 1).alias("hora"),
        F.col("pair.y_pred").alias("pml_pred"),
        F.col("pair.y_true").alias("pml_actual"),
        "model_name",
        F.lit(loomgrid.__version__).alias("model_version"),
        (
            F.col("origin_date").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(ISSUE_HOUR))
        ).alias("issued_at"),
        (F.current_timestamp() if run_at is None else run_at).alias("run_at"),
        "split",
        "sample_id",
    ).select(*PREDICTION_COLUMNS)


@dataclass
class EvaluationReport:
    """Named tables of a model comparison."""

    headline: DataFrame
    by_subset: DataFrame
    by_region: DataFrame
    by_hour: DataFrame
    example: DataFrame


def evaluation_report(
    ds: Dataset, forecasts: DataFrame, models: list[str], k: int = 4
) -> EvaluationReport:
    """Metrics per subset, per region side by side, per hour, and one example."""
    if REFERENCE not in models:
        raise ValueError(f"reference model {REFERENCE} not in models")
    scored = evaluate.score(forecasts, k, "y_ref")
    index = ds.positions("test")
    headline = index.agg(
        F.count("*").alias("n_samples"),
        F.countDistinct("node").alias("n_nodes"),
        F.min("target_date").alias("first_target"),
        F.max("target_date").alias("last_target"),
        F.count_if("is_spike_day").alias("n_spike_days"),
    )
    return EvaluationReport(
        headline,
        evaluate.summarize(scored, ["model_name"]),
        evaluate.region_table(scored, models),
        evaluate.mae_by_hour(forecasts, ["model_name"]),
        evaluate.example_sample(index),
    )
