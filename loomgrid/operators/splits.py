"""Train / validation / test labels and hold-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.config import UNKNOWN, Settings
from loomgrid.operators.numbering import number_in_order


def _starts(last: Column, settings: Settings) -> tuple[Column, Column]:
    """First validation and first test day for a last target date."""
    test_start = F.date_add(F.add_months(last, -settings.test_months), 1)
    return F.date_sub(test_start, settings.val_days), test_start


def split_bounds(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of split boundaries, from the last target date."""
    val_start, test_start = _starts(F.col("test_end"), settings)
    return samples.agg(F.max("target_date").alias("test_end")).select(
        F.date_sub(val_start, 1).alias("train_end"),
        val_start.alias("val_start"),
        F.date_sub(test_start, 1).alias("val_end"),
        test_start.alias("test_start"),
        "test_end",
    )


def split_label(target: Column, val_start: Column, test_start: Column) -> Column:
    return (
        F.when(target >= test_start, "test").when(target >= val_start, "val").otherwise("train")
    )


def assign_splits(
    samples: DataFrame, settings: Settings = Settings(), index: DataFrame | None = None
) -> DataFrame:
    """Label samples by target date: the last months are test, the days before val.

    The last date is read by a scalar subquery. ``index`` is a cheaper relation
    with the same target dates, where the caller has one.
    """
    source = samples if index is None else index
    last = source.agg(F.max("target_date").alias("d")).scalar()
    return samples.withColumn("split", split_label(F.col("target_date"), *_starts(last, settings)))


def target_days(index: DataFrame, split: str = "test") -> DataFrame:
    """Walk-forward order: target days of a split with their sample count."""
    return (
        index.where(F.col("split") == split)
        .groupBy("target_date")
        .agg(F.count("*").alias("n_samples"))
        .orderBy("target_date")
    )


def _node_zones(index: DataFrame) -> DataFrame:
    return index.select("node", "zone").distinct()


def node_folds(index: DataFrame, max_folds: int | None = None) -> DataFrame:
    """``(held_out, zone, fold)``: nodes whose zone keeps another node, in order."""
    nodes = _node_zones(index)
    shared = nodes.groupBy("zone").agg(F.count("*").alias("n")).where("n >= 2")
    eligible = nodes.join(shared.select("zone"), "zone", "left_semi")
    if max_folds is not None:
        eligible = eligible.orderBy("node").limit(max_folds)
    placed = number_in_order(eligible, [], "node", "place")
    return placed.select(
        F.col("node").alias("held_out"), "zone", (F.col("place") + 1).alias("fold")
    )


def zone_folds(index: DataFrame, max_folds: int | None = 3) -> DataFrame:
    """``(held_out, n_nodes, fold)``: known zones, the largest first."""
    zones = (
        _node_zones(index)
        .where(F.col("zone") != UNKNOWN)
        .groupBy("zone")
        .agg(F.count("*").alias("n_nodes"))
    )
    order = [F.desc("n_nodes"), F.asc("zone")]
    if max_folds is not None:
        zones = zones.orderBy(*order).limit(max_folds)
    return zones.select(
        F.col("zone").alias("held_out"),
        "n_nodes",
        F.row_number().over(Window.orderBy(*order)).alias("fold"),
    )


def fold_counts(index: DataFrame, folds: DataFrame, by: str) -> DataFrame:
    """Samples per fold and role: others' train / val and the held-out test.

    Counted from totals per split minus the held-out part, so the samples are
    read once whatever the number of folds.
    """
    held = index.groupBy(F.col(by).alias("held_out")).agg(
        *[F.count_if(F.col("split") == s).alias(f"h_{s}") for s in ("train", "val", "test")]
    )
    totals = index.groupBy("split").count()

    def total(split: str) -> Column:
        found = totals.where(F.col("split") == split).agg(F.sum("count").alias("n"))
        return F.coalesce(found.scalar(), F.lit(0))

    return folds.join(held, "held_out").select(
        "held_out",
        (total("train") - F.col("h_train")).alias("n_train"),
        (total("val") - F.col("h_val")).alias("n_val"),
        F.col("h_test").alias("n_test"),
    )


def fold_roles(index: DataFrame, folds: DataFrame, by: str) -> DataFrame:
    """Long relation ``(held_out, sample, role)`` for a bounded number of folds.

    Every sample appears once per fold it plays a role in. The fold labels ride on
    each sample as one short array, so no join of samples and folds is needed.
    """
    labels = folds.agg(F.sort_array(F.collect_list("held_out")).alias("labels"))
    tagged = index.withColumn("held_out", F.explode(labels.scalar()))
    inside = F.col("held_out") == F.col(by)
    role = F.when(inside & (F.col("split") == "test"), "test").when(
        ~inside & F.col("split").isin("train", "val"), F.col("split")
    )
    return tagged.withColumn("role", role).where(F.col("role").isNotNull())


def zone_dropout(
    samples: DataFrame, rate: float, seed: int = 0, key: tuple[str, ...] = ("sample_id",)
) -> DataFrame:
    """Replace the zone index by UNKNOWN (0) with probability ``rate``.

    Drawn from a digest of the sample's key and the seed, so a rerun on another layout
    draws the same.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / 2**32
    keep = draw >= rate
    return samples.withColumn("zone_idx", F.when(keep, F.col("zone_idx")).otherwise(F.lit(0)))
