"""Incremental ingestion of envelopes with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgrid.config import TIME_ZONE, SeriesSpec
from loomgrid.operators.cleaning import first_observed
from loomgrid.schemas import ENVELOPE, SILVER_COLUMNS
from loomgrid.session import stage
from loomgrid.sources.bronze import ENVELOPE_FILES, envelope_rows
from loomgrid.sources.silver import BUCKETS, upsert_silver

SERIES = SeriesSpec(keys=("market", "node"))


def envelope_stream(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """Stream of envelopes as they land; gzipped files are read natively."""
    reader = (
        spark.readStream.schema(ENVELOPE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", ENVELOPE_FILES)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def merge_batch(
    silver_path: str,
    spec: SeriesSpec = SERIES,
    max_interp: int = 3,
    tz: str = TIME_ZONE,
    buckets: int = BUCKETS,
    after: Callable[[DataFrame, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch function that merges the rows of new envelopes into silver.

    The merge keeps rows that are already there, so a replayed batch is harmless
    and late rows never replace observed ones. ``after`` runs once the batch is
    merged, for instance to score forecasts whose prices just arrived.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = first_observed(envelope_rows(batch, spec, tz), spec, ["path"])
        # written once: the merge reads the rows several times
        rows = stage(rows.select(*SILVER_COLUMNS), "batch")
        if not rows.isEmpty():
            upsert_silver(batch.sparkSession, silver_path, rows, spec, max_interp, buckets)
            if after is not None:
                after(batch, batch_id)

    return run


def ingest(
    spark: SparkSession,
    bronze_path: str,
    silver_path: str,
    checkpoint: str,
    max_files: int | None = None,
    **options,
) -> StreamingQuery:
    """Start a run over every envelope not processed yet; it ends when caught up."""
    return (
        envelope_stream(spark, bronze_path, max_files)
        .writeStream.foreachBatch(merge_batch(silver_path, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
