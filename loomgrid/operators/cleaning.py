"""From price records to observed rows on the local clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.config import OBSERVED, PRICES, TIME_ZONE, SeriesSpec
from loomgrid.functions import calendar, clock
from loomgrid.functions.scaling import clean
from loomgrid.schemas import SILVER_COLUMNS


def last_record(records: DataFrame, spec: SeriesSpec, order: list[str]) -> DataFrame:
    """One record per (series, day, hour): the last one in ``order``.

    An aggregate rather than a ranking window, so repeats of one hot key are
    combined before the shuffle.
    """
    keys = [*spec.keys, "fecha", "hora"]
    rest = [c for c in records.columns if c not in keys and c not in order]
    kept = F.max_by(F.struct(*rest), F.struct(*order)).alias("kept")
    return records.groupBy(*keys).agg(kept).select(*keys, "kept.*")


def first_observed(
    rows: DataFrame, spec: SeriesSpec, order: list[str], by: str = "ts_local"
) -> DataFrame:
    """Observed rows, one per (series, time): the first one in ``order`` wins."""
    keys = [*spec.keys, by]
    rest = [c for c in rows.columns if c not in keys]
    kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("kept")
    observed = rows.where(F.col("quality").isin(list(OBSERVED)))
    return observed.groupBy(*keys).agg(kept).select(*keys, "kept.*")


def _row(hora: Column, quality: str, source: Column, values: list[Column]) -> Column:
    return F.struct(
        hora.cast("int").alias("hora"),
        F.lit(quality).alias("quality"),
        source.cast("int").alias("source_hora"),
        *[v.alias(c) for v, c in zip(values, PRICES)],
    )


def align_daylight_saving(
    records: DataFrame, spec: SeriesSpec, tz: str = TIME_ZONE
) -> DataFrame:
    """Map sequential day hours onto the 24 clock slots.

    Needs one record per (series, day, hour). On a 23-hour day the skipped slot 3
    becomes the mean of its neighbours (``dst_fill``); on a 25-hour day records 2
    and 3 share slot 2 (``dst_merge``). Days with any other record count keep
    their hours up to 24. A null neighbour gives a null mean.
    """
    # one order for all, which is that of ``last_record``, so that a day is sorted once
    ordered = Window.partitionBy(*spec.keys, "fecha").orderBy("hora")
    day = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prices = F.struct(*PRICES)
    hora = F.col("hora")
    rows = records.select(
        "*",
        calendar.dst_kind(F.col("fecha"), tz).alias("_kind"),
        F.count("*").over(day).alias("_n"),
        F.max("hora").over(day).alias("_max"),
        F.lag(prices).over(ordered).alias("_before"),
    )
    short = (F.col("_kind") == "spring") & (F.col("_n") == 23) & (F.col("_max") == 23)
    long = (F.col("_kind") == "fall") & (F.col("_n") == 25) & (F.col("_max") == 25)
    own = [F.col(c) for c in PRICES]
    mean = [(F.col(c) + F.col(f"_before.{c}")) / 2 for c in PRICES]
    absent = F.lit(None)
    as_is = _row(hora, "ok", hora, own)
    spring = (
        F.when(
            hora == 3,
            F.array(_row(F.lit(4), "ok", hora, own), _row(F.lit(3), "dst_fill", absent, mean)),
        )
        .when(hora > 3, F.array(_row(hora + 1, "ok", hora, own)))
        .otherwise(F.array(as_is))
    )
    # record 3 carries its predecessor and emits the merged slot, so record 2 emits none
    fall = (
        F.when(hora == 2, F.filter(F.array(as_is), lambda _: F.lit(False)))
        .when(hora == 3, F.array(_row(F.lit(2), "dst_merge", F.lit(2), mean)))
        .when(hora > 3, F.array(_row(hora - 1, "ok", hora, own)))
        .otherwise(F.array(as_is))
    )
    emitted = F.when(short, spring).when(long, fall).otherwise(
        F.filter(F.array(as_is), lambda r: r["hora"] <= 24)
    )
    keep = [c for c in records.columns if c not in PRICES and c != "hora"]
    return rows.select(*keep, F.inline(emitted))


def records_to_hourly(
    records: DataFrame,
    spec: SeriesSpec,
    order: list[str],
    sistema: str = "SIN",
    market: str = "MDA",
    tz: str = TIME_ZONE,
    ingested_at: Column | None = None,
    by_day: bool = False,
) -> DataFrame:
    """Observed silver rows (``ok``, ``dst_fill``, ``dst_merge``) from price records.

    ``order`` names the arrival order of the records; the last of several records
    of one hour wins. ``sistema`` and ``market`` fill the columns of that name
    where the records do not carry them. ``by_day`` is for keys whose days hold few
    records, repeats included: these are shuffled and sorted once, by day, where
    else repeats are combined first.
    """
    clock.require_utc(records)
    labels = {"sistema": sistema, "market": market}
    typed = records.select(
        *[F.col(k) for k in spec.keys],
        *[
            (F.col(c) if c in records.columns else F.lit(v)).alias(c)
            for c, v in labels.items()
            if c not in spec.keys
        ],
        F.col("fecha").cast("date").alias("fecha"),
        F.col("hora").cast("int").alias("hora"),
        *[
            (clean(F.expr(f"try_cast({c} as double)")) if c in records.columns
             else F.lit(None).cast("double")).alias(c)
            for c in PRICES
        ],
        *[F.col(c) for c in order],
    )
    if by_day:
        typed = typed.repartition(*spec.keys, "fecha")
    aligned = align_daylight_saving(last_record(typed, spec, order), spec, tz)
    stamp = F.current_timestamp() if ingested_at is None else ingested_at
    slot = clock.slot_in_block(F.col("fecha"), F.col("hora"), spec)
    return aligned.withColumn("ts_local", clock.ts_of_slot(slot, spec)).withColumn(
        "ingested_at", stamp
    ).select(*dict.fromkeys([*spec.keys, *SILVER_COLUMNS]))
