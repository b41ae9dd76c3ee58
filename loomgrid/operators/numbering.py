"""Ordered numbers and exact quantiles without one-task groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import stage

def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in partitions by range of ``order``, their number as ``_part``.

    Written once: range bounds come from a sample, so that a second evaluation could
    draw others. Every type that sorts can be numbered this way.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(count, *order).withColumn("_part", F.spark_partition_id())
    return stage(parts, "ranged")


def number_in_order(df: DataFrame, groups: list[str], key: str, name: str) -> DataFrame:
    """0-based position of each row of a group in ``key`` order (keys are unique).

    Rows are ranked per range partition and partitions are offset by their counts, so a
    large group spreads over tasks.
    """
    rows = ranged(df, [*groups, key])
    counts = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part")
    starts = counts.select(
        *groups, "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_start")
    )
    rank = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(key)) - 1
    return (
        rows.withColumn("_rank", rank)
        .join(starts, [*groups, "_part"])
        .withColumn(name, (F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_part", "_start", "_rank")
    )


def range_part(df: DataFrame, key: str, parts: int) -> Column:
    """Number of the range of ``key`` (a number) that a row lies in, out of about ``parts``
    ranges of equal rows; rows without a key lie in the first.

    The driver holds one bound per range. A bound is found in two steps, so the work of a
    row grows with the square root of their number only.
    """
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, 20 * parts)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda bound: bound <= F.col(key)))

    lasts = passed(F.lit([group[-1] for group in groups]))
    inner = F.get(F.lit(groups), lasts)
    return lasts * step + F.when(inner.isNull(), F.lit(0)).otherwise(passed(inner))


BUCKETS_PER_OCTAVE = 1024


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a number, of constant relative width."""
    size = F.log2(F.abs(value) + 1) * BUCKETS_PER_OCTAVE
    return F.floor(F.signum(value) * size).cast("bigint")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per probability.

    A histogram of fixed buckets locates the bucket of every wanted rank; only the rows of
    those buckets are then shuffled and their distinct values ranked. Neither step holds a whole
    group in one task, unlike an aggregate that collects the values.
    """
    # a constant key keeps the ungrouped case on the same path
    groups = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(1))
    rows = rows.where(F.col(value).isNotNull()).select(
        *groups, F.col(value).alias("v"), value_bucket(F.col(value)).alias("b")
    )
    histogram = rows.groupBy(*groups, "b").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*groups).orderBy("b"))
    total = F.sum("n").over(Window.partitionBy(*groups))
    histogram = histogram.select(
        *groups, "b", "n", (upto - F.col("n")).alias("start"), total.alias("total")
    )
    wanted = []
    for name, p in probabilities.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted.append(
                F.struct(
                    F.lit(name).alias("name"),
                    F.lit(side).alias("side"),
                    rank.cast("bigint").alias("rank"),
                    (at - F.floor(at)).alias("share"),
                )
            )
    inside = F.filter(
        F.array(*wanted),
        lambda r: (r["rank"] >= F.col("start")) & (r["rank"] < F.col("start") + F.col("n")),
    )
    needed = histogram.select(*groups, "b", "start", inside.alias("ranks")).where(
        F.size("ranks") > 0
    )
    # at most two buckets per group and probability; written, so that Spark knows their size
    # and need not shuffle the values of all others to find theirs
    needed = stage(needed, "needed")
    ranked = rows.join(needed.select(*groups, "b"), [*groups, "b"], "left_semi")
    ranked = ranked.groupBy(*groups, "b", "v").agg(F.count("*").alias("n"))
    ranked = ranked.join(needed, [*groups, "b"])
    last = F.sum("n").over(Window.partitionBy(*groups, "b").orderBy("v")) + F.col("start")
    ranked = ranked.withColumn("stop", last).withColumn(
        "hits",
        F.filter(
            "ranks",
            lambda r: (r["rank"] >= F.col("stop") - F.col("n")) & (r["rank"] < F.col("stop")),
        ),
    )
    found = ranked.select(*groups, "v", F.explode("hits").alias("hit"))

    def pick(name: str, field: str | Column) -> Column:
        lo = F.max(F.when((F.col("hit.name") == name) & (F.col("hit.side") == "lo"), F.col("v")))
        hi = F.max(F.when((F.col("hit.name") == name) & (F.col("hit.side") == "hi"), F.col("v")))
        share = F.max(F.when(F.col("hit.name") == name, F.col("hit.share")))
        return (lo + (hi - lo) * share).alias(field)

    out = found.groupBy(*groups).agg(*[pick(n, n) for n in probabilities])
    return out if keys else out.drop("_all")
