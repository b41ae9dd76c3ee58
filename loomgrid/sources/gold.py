"""Gold tables: predictions, datasets, daily forecasts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.config import SeriesSpec, Settings
from loomgrid.plans.dataset import Dataset
from loomgrid.schemas import PREDICTION_COLUMNS


def _replace(df: DataFrame, path: str, by: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Store predictions by model; only the models present are replaced."""
    _replace(predictions, path, "model_name")


def read_predictions(
    spark: SparkSession,
    path: str,
    models: list[str] | None = None,
    nodes: list[str] | DataFrame | None = None,
) -> DataFrame:
    """Predictions of all or some models as one table; absent models are skipped."""
    rows = spark.read.parquet(path)
    if models is not None:
        rows = rows.where(F.col("model_name").isin(list(models)))
    if isinstance(nodes, DataFrame):
        rows = rows.join(nodes.select("node").distinct(), "node", "left_semi")
    elif nodes is not None:
        rows = rows.where(F.col("node").isin(list(nodes)))
    return rows.select(*PREDICTION_COLUMNS)


def save_dataset(ds: Dataset, path: str) -> None:
    """Write samples (by split) and the metadata row."""
    ds.samples.write.mode("overwrite").partitionBy("split").parquet(f"{path}/samples")
    ds.meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_dataset(
    spark: SparkSession, path: str, spec: SeriesSpec, settings: Settings
) -> Dataset:
    samples = spark.read.parquet(f"{path}/samples")
    return Dataset(samples, spark.read.parquet(f"{path}/meta"), spec, settings)


def merge_forecasts(forecasts: DataFrame, path: str) -> None:
    """Store daily forecasts; an earlier run of the same target day is replaced."""
    _replace(forecasts.sortWithinPartitions("target_date", "node", "hora"), path, "target_date")


def append_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").partitionBy("target_date").parquet(path)
