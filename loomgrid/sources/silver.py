"""Silver tables: layout, versions, pruned reads and idempotent merges.

A table is a folder of versions and of manifests. A write puts the partitions it replaces (market, bucket of
nodes, year) into a version of its own, then adds the manifest that says which version each partition is
read from. Readers take the newest manifest, so they see the state before a write or behind it, also while
it runs or if it fails; what a failed write left is overwritten by the next one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.config import OBSERVED, PRICES, SeriesSpec
from loomgrid.operators.cleaning import first_observed
from loomgrid.operators.grid import build_grid
from loomgrid.schemas import SILVER_COLUMNS

# series are spread over this many folders; a merge rewrites only those it touches
BUCKETS = 64
PARTITIONS = ("market", "bucket", "year")
DATA, MANIFESTS = "data", "_manifests"


def bucket_of(node: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def _system(spark: SparkSession, path: str):
    """A path and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the table's states, in order; none where there is no table."""
    folder, system = _system(spark, f"{path}/{MANIFESTS}")
    if not system.exists(folder):
        return []
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n[:1].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[tuple, int]:
    """Version that each partition is read from, in a state of the table or the newest one.

    It has a row per market, bucket and year, whatever the number of rows.
    """
    known = versions(spark, path)
    if not known:
        return {}
    number = known[-1] if version is None else version
    kinds = ", ".join([*(f"{c} {'string' if c == 'market' else 'int'}" for c in PARTITIONS), "version int"])
    rows = spark.read.schema(kinds).json(f"{path}/{MANIFESTS}/{number}.json").collect()
    return {tuple(r[c] for c in PARTITIONS): r["version"] for r in rows}


def _publish(spark: SparkSession, path: str, number: int, entries: dict[tuple, int]) -> None:
    """Add a manifest: written aside, then renamed, so that it is there whole or not at all."""
    lines = [json.dumps({**dict(zip(PARTITIONS, k)), "version": v}) for k, v in sorted(entries.items())]
    aside, system = _system(spark, f"{path}/{MANIFESTS}/_{number}-{uuid.uuid4().hex}")
    final, _ = _system(spark, f"{path}/{MANIFESTS}/{number}.json")
    out = system.create(aside, False)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
    if system.exists(final) or not system.rename(aside, final):
        raise RuntimeError(f"another write made version {number} of {path} first")


def write_silver(silver: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write rows by market, bucket of nodes and year, sorted by node and time, as a new version.

    Only the partitions present in ``silver`` are replaced. A year of one bucket
    goes to one file, so a long series is split by year.
    """
    spark = silver.sparkSession
    number = max(versions(spark, path), default=0) + 1
    rows = silver.withColumns(
        {"bucket": bucket_of(F.col("node"), buckets), "year": F.year("fecha")}
    )
    folder = f"{path}/{DATA}/version={number}"
    (
        rows.repartition(*PARTITIONS)
        .sortWithinPartitions(*PARTITIONS, "node", "ts_local")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*PARTITIONS)
        .parquet(folder)
    )
    written = spark.read.parquet(folder).select(*PARTITIONS).distinct().collect()
    fresh = {tuple(r[c] for c in PARTITIONS): number for r in written}
    _publish(spark, path, number, {**manifest(spark, path), **fresh})


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all states but the last ``keep``, and the partitions that only they read."""
    known = versions(spark, path)
    kept, old = known[-keep:], known[:-keep]
    used = {x for number in kept for x in manifest(spark, path, number).items()}
    for number in old:
        for entry in manifest(spark, path, number).items():
            if entry not in used:
                folder, system = _system(spark, _partition(path, *entry))
                system.delete(folder, True)
    for number in old:
        file, system = _system(spark, f"{path}/{MANIFESTS}/{number}.json")
        system.delete(file, False)


def _partition(path: str, partition: tuple, version: int) -> str:
    parts = "/".join(f"{c}={v}" for c, v in zip(PARTITIONS, partition))
    return f"{path}/{DATA}/version={version}/{parts}"


def stored(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    market: str | None = None,
    years: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """Rows of a state of the table; partitions of other markets and years are not even listed."""
    entries = manifest(spark, path, version)
    first, last = years
    wanted = [
        _partition(path, p, v)
        for p, v in entries.items()
        if (market is None or p[0] == market)
        and (first is None or p[2] >= first)
        and (last is None or p[2] <= last)
    ]
    reader = spark.read.option("basePath", f"{path}/{DATA}")
    if not wanted:  # any partition tells the columns
        return reader.parquet(_partition(path, *next(iter(entries.items())))).where(F.lit(False))
    return reader.parquet(*wanted)


def read_silver(
    spark: SparkSession,
    path: str,
    market: str | None = "MDA",
    nodes: list[str] | DataFrame | None = None,
    start=None,
    end=None,
    columns: list[str] | None = None,
    buckets: int = BUCKETS,
    version: int | None = None,
) -> DataFrame:
    """Silver rows of a market, pruned by node, operation date and column.

    A list of nodes prunes whole buckets; dates prune years. Row groups are then
    skipped on the pushed-down predicates. ``version`` reads an earlier state that is still kept.
    """
    years = tuple(None if d is None else int(str(d)[:4]) for d in (start, end))
    rows = stored(spark, path, version, market, years)
    if market is not None:
        rows = rows.where(F.col("market") == market)
    if isinstance(nodes, DataFrame):
        rows = rows.join(nodes.select("node").distinct(), "node", "left_semi")
    elif nodes is not None:
        wanted = list(nodes)
        in_bucket = [bucket_of(F.lit(n), buckets) for n in wanted]
        rows = rows.where(F.col("bucket").isin(in_bucket) & F.col("node").isin(wanted))
    if start is not None:
        day = F.lit(start).cast("date")
        rows = rows.where((F.col("fecha") >= day) & (F.col("year") >= F.year(day)))
    if end is not None:
        day = F.lit(end).cast("date")
        rows = rows.where((F.col("fecha") <= day) & (F.col("year") <= F.year(day)))
    return rows.select(*(columns or SILVER_COLUMNS))


def merge_observed(
    existing: DataFrame | None, incoming: DataFrame, spec: SeriesSpec, max_interp: int = 3
) -> DataFrame:
    """Grid of existing and incoming observed rows; an existing row always wins.

    Derived rows are computed again from the observed ones, so applying the same
    rows twice changes nothing. Markets are kept apart whether or not the key names
    them. Rows that are equal in priority and time are told apart by their prices.
    """
    spec = by_market(spec, incoming)
    fresh = incoming.withColumn("priority", F.lit(1))
    rows = fresh if existing is None else existing.withColumn(
        "priority", F.lit(0)
    ).unionByName(fresh, allowMissingColumns=True)
    order = ["priority", "ingested_at", *[c for c in PRICES if c in rows.columns]]
    unique = first_observed(rows, spec, order)
    return build_grid(unique, spec, max_interp)


def by_market(spec: SeriesSpec, rows: DataFrame) -> SeriesSpec:
    """The series of each market on its own, where rows have a market."""
    if "market" in spec.keys or "market" not in rows.columns:
        return spec
    return replace(spec, keys=("market", *spec.keys))


def upsert_silver(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    spec: SeriesSpec = SeriesSpec(keys=("market", "node")),
    max_interp: int = 3,
    buckets: int = BUCKETS,
) -> None:
    """Merge observed rows into a silver table.

    Only the (market, bucket) folders of incoming nodes are read and rewritten, in a
    version of their own, so the table is never read and overwritten in one job and a
    failed run can be repeated.
    """
    keyed = incoming.withColumn("bucket", bucket_of(F.col("node"), buckets))
    existing = None
    if versions(spark, path):
        # bounded by markets x buckets
        touched = keyed.select("market", "bucket").distinct().collect()
        pick = F.lit(False)
        for market in sorted({r["market"] for r in touched}):
            numbers = [r["bucket"] for r in touched if r["market"] == market]
            pick = pick | ((F.col("market") == market) & F.col("bucket").isin(numbers))
        existing = (
            stored(spark, path)
            .where(pick & F.col("quality").isin(list(OBSERVED)))
            .select(*SILVER_COLUMNS)
        )
    merged = merge_observed(existing, incoming.select(*SILVER_COLUMNS), spec, max_interp)
    write_silver(merged.select(*SILVER_COLUMNS), path, buckets)
