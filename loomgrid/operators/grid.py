"""Gap-free grids, gap runs and placeholder days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.config import DERIVED, OBSERVED, PENDING, PRICES, SeriesSpec
from loomgrid.functions import clock
from loomgrid.operators.chunks import chunk_keys, chunk_window, with_slots
from loomgrid.schemas import SILVER_COLUMNS


def _anchor_summary(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row per chunk with what its neighbours need to close their edge gaps."""
    keys = ", ".join(spec.keys)
    per_price = [
        part
        for c in PRICES
        for part in (
            f"min(IF({c} IS NULL, NULL, slot)) AS fs_{c}",
            f"min_by({c}, IF({c} IS NULL, NULL, slot)) AS fv_{c}",
            f"max(IF({c} IS NULL, NULL, slot)) AS ls_{c}",
            f"max_by({c}, IF({c} IS NULL, NULL, slot)) AS lv_{c}",
        )
    ]
    summary = rows.groupBy(*chunk_keys(spec)).agg(
        F.expr("min(slot) AS lo"), *map(F.expr, per_price)
    )
    over = f"OVER (PARTITION BY {keys} ORDER BY chunk)"
    earlier = (
        f"OVER (PARTITION BY {keys} ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    carried = [
        part
        for c in PRICES
        for part in (
            f"last(IF(ls_{c} IS NULL, NULL, struct(ls_{c} AS slot, lv_{c} AS v)), true)"
            f" {earlier} AS cl_{c}",
            f"lead(IF(fs_{c} IS NULL, NULL, struct(fs_{c} AS slot, fv_{c} AS v)))"
            f" IGNORE NULLS {over} AS cr_{c}",
        )
    ]
    return summary.selectExpr(
        *chunk_keys(spec),
        f"lead(lo) {over} AS next_lo",
        f"lag(lo) {over} IS NULL AS opens",
        *carried,
    )


def build_grid(observed: DataFrame, spec: SeriesSpec, max_interp: int = 3) -> DataFrame:
    """Continuous grid from the first to the last observed block of each series.

    ``observed`` holds at most one observed row per (series, step); use
    ``first_observed`` where repeats may occur. Runs of up to ``max_interp``
    absent steps between observed ones are interpolated linearly per column
    (``interp``); longer runs and the edges of the outer blocks stay null
    (``missing``). Every observed row emits itself and the gap that follows, so
    no calendar is joined and only chunk summaries travel between chunks.
    """
    clock.require_utc(observed)
    keys, n = chunk_keys(spec), spec.steps_per_block
    carry = [c for c in ("market", "sistema") if c not in spec.keys]
    slot = clock.slot_of(F.col("ts_local"), spec)
    rows = (
        observed.where(F.col("quality").isin(list(OBSERVED)))
        .withColumn("slot", slot)
        .withColumn("chunk", F.floor(F.col("slot") / (n * spec.chunk_blocks)))
        # explicit key filters: the join below would add them to one of its sides only,
        # and the two sides could then not share the exchange under them
        .where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        .select(*keys, "slot", *carry, *PRICES, "quality", "source_hora", "ingested_at")
    )
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY slot)"
    so_far = over[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    near = [
        part
        for c in PRICES
        for part in (
            f"last(IF({c} IS NULL, NULL, struct(slot, {c} AS v)), true) {so_far} AS nl_{c}",
            f"lead(IF({c} IS NULL, NULL, struct(slot, {c} AS v))) IGNORE NULLS {over} AS nr_{c}",
        )
    ]
    # shuffle the plain columns; the anchors are derived after the exchange
    linked = rows.repartition(*keys).selectExpr(
        "*",
        f"floor(slot / {n}) * {n} AS block_start",
        f"lead(slot) {over} AS next_in",
        f"lag(slot) {over} IS NULL AS leads",
        *near,
    )
    linked = linked.join(_anchor_summary(rows, spec), keys)
    carried = [f"nvl({near}{c}, {far}{c}) AS {side}{c}" for c in PRICES
               for side, near, far in (("l_", "nl_", "cl_"), ("r_", "nr_", "cr_"))]
    kept = [*spec.keys, *carry, "slot", *PRICES, "quality", "source_hora", "ingested_at"]
    emitted = linked.selectExpr(
        *kept,
        *carried,
        "nvl(next_in, next_lo) AS next_slot",
        "explode(sequence(IF(leads AND opens, block_start, slot),"
        f" nvl(nvl(next_in, next_lo) - 1, block_start + {n - 1}))) AS at",
    )
    line = {
        c: f"l_{c}.v + (r_{c}.v - l_{c}.v) / (r_{c}.slot - l_{c}.slot) * (at - l_{c}.slot)"
        for c in PRICES
    }
    short = (
        f"at > slot AND next_slot - slot - 1 <= {max_interp}"
        " AND l_pml IS NOT NULL AND r_pml IS NOT NULL"
    )
    filled = emitted.selectExpr(*kept, "at", f"({short}) AS short", *[
        f"CASE WHEN at = slot THEN {c} WHEN {short} THEN {line[c]} END AS at_{c}" for c in PRICES
    ])
    out = filled.select(
        *spec.keys,
        *carry,
        clock.ts_of_slot(F.col("at"), spec).alias("ts_local"),
        clock.date_of_block(clock.block_of_slot(F.col("at"), spec), spec).alias("fecha"),
        clock.hora_of_slot(F.col("at"), spec).alias("hora"),
        *[F.col(f"at_{c}").alias(c) for c in PRICES],
        F.expr(
            "CASE WHEN at = slot THEN quality WHEN short THEN 'interp' ELSE 'missing' END"
        ).alias("quality"),
        F.expr("IF(at = slot, source_hora, NULL)").alias("source_hora"),
        F.expr("IF(at = slot, ingested_at, NULL)").alias("ingested_at"),
    )
    return out.select(*dict.fromkeys([*spec.keys, *SILVER_COLUMNS]))


def gap_table(silver: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Runs of derived steps: ``start``, ``end``, ``n_hours`` and ``kind``.

    Runs are found inside chunks; only those that touch a chunk edge (two per
    chunk at most) go through a second pass per series.
    """
    keys = chunk_keys(spec)
    derived = with_slots(silver.where(F.col("quality").isin(list(DERIVED))), spec)
    derived = derived.select(
        *keys,
        "slot",
        "quality",
        (F.col("slot") - F.row_number().over(chunk_window(spec))).alias("run"),
    )
    runs = derived.groupBy(*keys, "run").agg(
        F.min("slot").alias("lo"),
        F.max("slot").alias("hi"),
        F.min_by("quality", "slot").alias("kind"),
    )
    size = spec.chunk_blocks * spec.steps_per_block
    first = F.col("chunk") * size
    edge = (F.col("lo") == first) | (F.col("hi") == first + size - 1)
    runs = runs.withColumn("edge", edge)
    along = Window.partitionBy(*spec.keys).orderBy("lo")
    joined = (
        runs.where("edge")
        .withColumn(
            "opens",
            F.coalesce(F.col("lo") != F.lag("hi").over(along) + 1, F.lit(True)).cast("int"),
        )
        .withColumn("run", F.sum("opens").over(along))
        .groupBy(*spec.keys, "run")
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("kind", "lo").alias("kind")
        )
    )
    columns = [*spec.keys, "lo", "hi", "kind"]
    whole = runs.where(~F.col("edge")).select(*columns).unionByName(joined.select(*columns))
    return whole.select(
        *spec.keys,
        clock.ts_of_slot(F.col("lo"), spec).alias("start"),
        clock.ts_of_slot(F.col("hi"), spec).alias("end"),
        (F.col("hi") - F.col("lo") + 1).alias("n_hours"),
        "kind",
    )


def with_target_blocks(
    silver: DataFrame, requests: DataFrame, spec: SeriesSpec
) -> DataFrame:
    """Append an empty ``pending`` block after the origin of each request.

    ``requests`` holds ``(keys, origin_date)``. The block is added only where the
    series ends exactly at the origin, so an earlier gap stays visible.
    """
    carry = [c for c in ("market", "sistema") if c not in spec.keys]
    last = silver.groupBy(*spec.keys).agg(
        F.max("fecha").alias("origin_date"),
        *[F.max_by(c, "ts_local").alias(c) for c in carry],
    )
    ends_here = requests.select(*spec.keys, "origin_date").distinct().join(
        last, [*spec.keys, "origin_date"]
    )
    block = clock.block_of_date(F.col("origin_date"), spec) + 1
    n = spec.steps_per_block
    slots = ends_here.withColumn(
        "slot", F.explode(F.sequence(block * n, block * n + n - 1))
    )
    filler = slots.select(
        *spec.keys,
        *carry,
        clock.ts_of_slot(F.col("slot"), spec).alias("ts_local"),
        clock.date_of_block(clock.block_of_slot(F.col("slot"), spec), spec).alias("fecha"),
        clock.hora_of_slot(F.col("slot"), spec).alias("hora"),
        F.lit(PENDING).alias("quality"),
    )
    return silver.unionByName(filler, allowMissingColumns=True)
