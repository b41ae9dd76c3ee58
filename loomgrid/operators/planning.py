"""Which requests are still needed to cover nodes over a range of days."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.config import (
    MTR_LAG_DAYS,
    EPOCHS,
    MARKETS,
    MAX_DAYS_PER_REQUEST,
    MAX_NODES_PER_REQUEST,
    SYSTEMS,
)
from loomgrid.operators.numbering import number_in_order


def last_published(market: Column, today: Column) -> Column:
    """Last day that a market has published: tomorrow, or some days ago for real-time prices."""
    return F.when(market == "MTR", F.date_sub(today, MTR_LAG_DAYS)).otherwise(F.date_add(today, 1))


def last_published_day(market: str, today: datetime.date) -> datetime.date:
    """The same for one market and day."""
    return today + datetime.timedelta(days=-MTR_LAG_DAYS if market == "MTR" else 1)


def window_number(day: Column, epoch: datetime.date) -> Column:
    """Index of the request window of a day, anchored at the market epoch."""
    days = F.datediff(day, F.lit(epoch))
    return F.floor(days / MAX_DAYS_PER_REQUEST).cast("bigint")


def _window_start(number: Column, epoch: datetime.date) -> Column:
    return F.date_add(F.lit(epoch), (number * MAX_DAYS_PER_REQUEST).cast("int"))


def _windows(rows: DataFrame, epoch: datetime.date, start, end) -> DataFrame:
    """Explode every row over the anchored windows that touch ``start``..``end``."""
    first = max(start, epoch)
    if end < first:
        return rows.where("false").withColumns(
            {
                "window": F.lit(0).cast("bigint"),
                "window_start": F.lit(epoch),
                "window_end": F.lit(epoch),
            }
        )
    spread = rows.withColumn(
        "window",
        F.explode(
            F.sequence(window_number(F.lit(first), epoch), window_number(F.lit(end), epoch))
        ),
    )
    begin = _window_start(F.col("window"), epoch)
    return spread.withColumns(
        {
            "window_start": begin,
            "window_end": F.least(F.date_add(begin, MAX_DAYS_PER_REQUEST - 1), F.lit(end)),
        }
    )


def epoch_windows(
    spark, market: str, start: datetime.date, end: datetime.date, epoch=None
) -> DataFrame:
    """Request windows covering a range of days; the last one is clipped."""
    rows = spark.range(1).select()
    return _windows(rows, epoch or EPOCHS[market], start, end)


def plan_requests(
    nodes: DataFrame,
    sistema: str,
    market: str,
    start: datetime.date,
    end: datetime.date,
    have: DataFrame | None = None,
    epoch: datetime.date | None = None,
    batch: int = MAX_NODES_PER_REQUEST,
    today: datetime.date | None = None,
) -> DataFrame:
    """Requests for every window and node not fully covered by ``have``.

    Given ``today``, nothing behind the last day that the market has published is asked for.

    ``have`` holds ``(node, fecha)`` pairs. Covered days are counted per node and
    window instead of spreading every node over every day. Nodes are batched in
    key order inside a window.
    """
    epoch = epoch or EPOCHS[market]
    if today is not None:
        end = min(end, last_published_day(market, today))
    wanted = _windows(nodes.select("node").distinct(), epoch, start, end)
    if have is not None:
        days = have.select("node", "fecha").where(
            (F.col("fecha") >= F.lit(epoch)) & (F.col("fecha") <= F.lit(end))
        )
        covered = (
            days.distinct()
            .groupBy("node", window_number(F.col("fecha"), epoch).alias("window"))
            .agg(F.count("*").alias("n_covered"))
        )
        span = F.datediff("window_end", "window_start") + 1
        wanted = (
            wanted.join(covered, ["node", "window"], "left")
            .where(F.coalesce("n_covered", F.lit(0)) < span)
            .drop("n_covered")
        )
    groups = ["window", "window_start", "window_end"]
    placed = number_in_order(wanted, groups, "node", "place")
    batches = placed.groupBy(*groups, F.floor(F.col("place") / batch).alias("batch")).agg(
        F.sort_array(F.collect_list("node")).alias("nodes")
    )
    return batches.select(
        F.lit(sistema).alias("sistema"),
        F.lit(market).alias("proceso"),
        "nodes",
        F.col("window_start").alias("start"),
        F.col("window_end").alias("end"),
    )


def request_key(requests: DataFrame, name: str = "key") -> DataFrame:
    """Short stable key of a request: dates, node count and a digest of the nodes."""
    digest = F.substring(F.sha1(F.concat_ws(",", "nodes").cast("binary")), 1, 12)
    key = F.concat(
        F.date_format("start", "yyyyMMdd"),
        F.lit("-"),
        F.date_format("end", "yyyyMMdd"),
        F.lit("__"),
        F.size("nodes").cast("string"),
        F.lit("n_"),
        digest,
    )
    return requests.withColumn(name, key)


def requested_pairs(envelopes: DataFrame) -> DataFrame:
    """Every ``(node, fecha)`` already requested, whatever the outcome."""
    nodes = envelopes.select(F.explode("nodes").alias("node"), "start", "end").distinct()
    days = nodes.select("node", F.explode(F.sequence("start", "end")).alias("fecha"))
    return days.distinct()


def available_pairs(covered: DataFrame, requested: DataFrame) -> DataFrame:
    """Pairs that need no request: complete days and days already asked for."""
    pairs = covered.select("node", "fecha").unionByName(requested.select("node", "fecha"))
    return pairs.distinct()


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``reject_reason``, null for requests within the service limits."""
    count = F.size("nodes")
    reason = (
        F.when(~F.coalesce(F.col("sistema").isin(list(SYSTEMS)), F.lit(False)), "unknown sistema")
        .when(~F.coalesce(F.col("proceso").isin(list(MARKETS)), F.lit(False)), "unknown proceso")
        .when(
            F.coalesce((count < 1) | (count > MAX_NODES_PER_REQUEST), F.lit(True)),
            "needs 1 to 20 nodes",
        )
        .when(F.col("end") < F.col("start"), "end before start")
        .when(
            F.datediff("end", "start") + 1 > MAX_DAYS_PER_REQUEST, "spans more than 7 days"
        )
    )
    return requests.withColumn("reject_reason", reason)
