"""Column expressions for the regular clock of a series.

A *slot* is the number of steps since the anchor, a *block* the number of
blocks since the anchor and ``hora`` the 1-based step inside its block.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.config import SeriesSpec


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def require_utc(df: DataFrame) -> None:
    """Local clocks are kept as zone-less timestamps read against a UTC session."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC, not {zone}")


def _anchor_seconds(spec: SeriesSpec) -> int:
    day = datetime.date.fromisoformat(spec.anchor)
    return (day - datetime.date(1970, 1, 1)).days * 86400


def slot_of(ts: Column, spec: SeriesSpec) -> Column:
    """Step number of a local timestamp (needs the UTC session, see ``require_utc``)."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.floor((seconds - _anchor_seconds(spec)) / spec.step_seconds)


def slot_in_block(fecha: Column, hora: Column, spec: SeriesSpec) -> Column:
    return block_of_date(fecha, spec) * spec.steps_per_block + hora - 1


def block_of_slot(slot: Column, spec: SeriesSpec) -> Column:
    return F.floor(slot / spec.steps_per_block)


def block_of_date(day: Column, spec: SeriesSpec) -> Column:
    days = F.datediff(day, F.lit(spec.anchor).cast("date"))
    return F.floor(days / spec.block_days)


def chunk_of_block(block: Column, spec: SeriesSpec) -> Column:
    return F.floor(block / spec.chunk_blocks)


def hora_of_slot(slot: Column, spec: SeriesSpec) -> Column:
    return (F.pmod(slot, F.lit(spec.steps_per_block)) + 1).cast("int")


def date_of_block(block: Column, spec: SeriesSpec) -> Column:
    return F.date_add(F.lit(spec.anchor).cast("date"), (block * spec.block_days).cast("int"))


def ts_of_slot(slot: Column, spec: SeriesSpec) -> Column:
    seconds = slot * spec.step_seconds + _anchor_seconds(spec)
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")
