"""Error, skill and product metrics of block forecasts.

Metrics work on one row per forecast with ``y_true`` and ``y_pred`` arrays, so a
sample never has to be exploded or shuffled to be scored; ``from_long`` builds
those rows from a long predictions table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.config import SUBSETS

METRICS = ("mae", "rmse", "smape", "skill", "top4_overlap", "captured_value", "n_samples")
SMAPE_GUARD = 1e-6


def top_positions(values: Column, k: int) -> Column:
    """0-based positions of the k largest values; ties go to the earlier one."""
    ranked = F.array_sort(
        F.transform(
            values,
            lambda v, i: F.struct(
                F.coalesce(-v, F.lit(float("inf"))).alias("down"), i.alias("at")
            ),
        )
    )
    return F.transform(F.slice(ranked, 1, k), lambda r: r["at"])


def overlap(y_true: Column, y_pred: Column, k: int) -> Column:
    """Share of the k largest actual positions found by the forecast."""
    common = F.array_intersect(top_positions(y_true, k), top_positions(y_pred, k))
    return F.size(common) / F.lit(float(k))


def _gain(y_true: Column, at: Column) -> Column:
    return F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(y_true, i))


def captured(y_true: Column, y_pred: Column, k: int) -> Column:
    """Share of the best k-position total taken; null unless that total is positive."""
    best = _gain(y_true, top_positions(y_true, k))
    return F.when(best > 0, _gain(y_true, top_positions(y_pred, k)) / best)


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def absolute_error(y_true: Column, y_pred: Column) -> Column:
    return _total(F.zip_with(y_true, y_pred, lambda t, p: F.abs(p - t)))


def squared_error(y_true: Column, y_pred: Column) -> Column:
    return _total(F.zip_with(y_true, y_pred, lambda t, p: (p - t) * (p - t)))


def smape_term(actual: Column, predicted: Column) -> Column:
    size = F.abs(actual) + F.abs(predicted)
    return F.when(size < SMAPE_GUARD, F.lit(0.0)).otherwise(
        F.abs(predicted - actual) * 2 / size
    )


def symmetric_error(y_true: Column, y_pred: Column) -> Column:
    return _total(F.zip_with(y_true, y_pred, smape_term))


def skill(mae: Column, reference: Column) -> Column:
    return F.when(reference > 0, 1 - mae / reference)


def block_window(prices: Column, size: int, expensive: bool = True) -> Column:
    """First contiguous run with the highest (lowest) total: 1-based start and end."""
    starts = F.sequence(F.lit(0), F.size(prices) - size)
    ranked = F.array_sort(
        F.transform(
            starts,
            lambda i: F.struct(
                (_total(F.slice(prices, i + 1, size)) * (-1 if expensive else 1)).alias("t"),
                i.alias("at"),
            ),
        )
    )
    at = ranked[0]["at"]
    return F.struct((at + 1).alias("start_hour"), (at + size).alias("end_hour"))


def from_long(predictions: DataFrame, keep: list[str]) -> DataFrame:
    """Fold a long predictions table into one row per ``keep`` with both arrays."""
    step = F.struct("hora", "pml_actual", "pml_pred")
    rows = predictions.groupBy(*keep).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return rows.withColumns(
        {
            "y_true": F.transform("steps", lambda s: s["pml_actual"]),
            "y_pred": F.transform("steps", lambda s: s["pml_pred"]),
        }
    ).drop("steps")


def shape_errors(forecasts: DataFrame, steps: int) -> DataFrame:
    """Forecasts whose arrays are not both ``steps`` long (empty when sound)."""
    good = (F.size("y_true") == steps) & (F.size("y_pred") == steps)
    return forecasts.where(~F.coalesce(good, F.lit(False)))


def score(forecasts: DataFrame, k: int = 4, reference: str | None = None) -> DataFrame:
    """Per-forecast metric terms. ``reference`` names a column of reference arrays."""
    y, p = F.col("y_true"), F.col("y_pred")
    ref = F.lit(None).cast("double") if reference is None else absolute_error(y, F.col(reference))
    return forecasts.withColumns(
        {
            "abs_sum": absolute_error(y, p),
            "sq_sum": squared_error(y, p),
            "smape_sum": symmetric_error(y, p),
            "ref_sum": ref,
            "steps": F.size(y).cast("double"),
            "overlap": overlap(y, p, k),
            "captured": captured(y, p, k),
        }
    )


def _aggregates(mask: Column | None = None, prefix: str = "") -> list[Column]:
    """Metric aggregates in ``METRICS`` order over scored rows inside ``mask``.

    Forecasts with an unknown step count in ``n_samples`` only.
    """

    def part(column: Column) -> Column:
        return column if mask is None else F.when(mask, column)

    known = F.col("abs_sum").isNotNull()
    steps = F.sum(part(F.when(known, F.col("steps"))))
    mae = F.sum(part(F.col("abs_sum"))) / steps
    both = known & F.col("ref_sum").isNotNull()
    ref_steps = F.sum(part(F.when(both, F.col("steps"))))
    ref_mae = F.sum(part(F.when(both, F.col("ref_sum")))) / ref_steps
    own_mae = F.sum(part(F.when(both, F.col("abs_sum")))) / ref_steps
    count = F.count(F.lit(1)) if mask is None else F.count_if(mask)
    return [
        mae.alias(f"{prefix}mae"),
        F.sqrt(F.sum(part(F.col("sq_sum"))) / steps).alias(f"{prefix}rmse"),
        (F.sum(part(F.col("smape_sum"))) * 100 / steps).alias(f"{prefix}smape"),
        skill(own_mae, ref_mae).alias(f"{prefix}skill"),
        F.avg(part(F.when(known, F.col("overlap")))).alias(f"{prefix}top4_overlap"),
        F.avg(part(F.col("captured"))).alias(f"{prefix}captured_value"),
        count.alias(f"{prefix}n_samples"),
    ]


def metrics_by(scored: DataFrame, by: list[str]) -> DataFrame:
    """All metrics per group."""
    return scored.groupBy(*by).agg(*_aggregates())


def summarize(scored: DataFrame, by: list[str]) -> DataFrame:
    """All metrics per group for all, normal and spike samples.

    One aggregate computes the three subsets side by side; an empty subset still
    gives a row, with null metrics and a zero count.
    """
    masks = {"all": F.lit(True), "no_spike": ~F.col("is_spike_day"), "spike": F.col("is_spike_day")}
    wide = scored.groupBy(*by).agg(
        *[a for s in SUBSETS for a in _aggregates(masks[s], f"{s}__")]
    )
    rows = [
        F.struct(F.lit(s).alias("subset"), *[F.col(f"{s}__{m}").alias(m) for m in METRICS])
        for s in SUBSETS
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def mae_by_hour(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute error of every step of the block."""
    pairs = F.posexplode(F.arrays_zip("y_true", "y_pred")).alias("at", "pair")
    return (
        forecasts.select(*by, pairs)
        .groupBy(*by, (F.col("at") + 1).alias("hora"))
        .agg(F.avg(F.abs(F.col("pair.y_pred") - F.col("pair.y_true"))).alias("mae"))
    )


# Suffixes of the flattened metric names.
SUFFIX = {"all": "", "no_spike": "_nospike", "spike": "_spike"}


def flat_metrics(summary: DataFrame, by: list[str]) -> DataFrame:
    """Summary as ``(by, metric, value)`` rows named ``test_<metric><suffix>``."""
    suffix = F.coalesce(*[F.when(F.col("subset") == s, F.lit(x)) for s, x in SUFFIX.items()])
    names = [m for m in METRICS if m != "n_samples"]
    rows = [
        F.struct(F.concat(F.lit(f"test_{m}"), suffix).alias("metric"), F.col(m).alias("value"))
        for m in names
    ]
    rows.append(
        F.struct(
            F.concat(F.lit("n_test"), suffix).alias("metric"),
            F.col("n_samples").cast("double").alias("value"),
        )
    )
    flat = summary.select(*by, F.inline(F.array(*rows)))
    return flat.where(F.col("value").isNotNull() & ~F.isnan("value"))


def region_table(scored: DataFrame, models: list[str]) -> DataFrame:
    """One row per region with the error and skill of every model side by side."""
    wanted = dict(zip(METRICS, _aggregates()))
    per = (
        scored.groupBy("region")
        .pivot("model_name", models)
        .agg(wanted["mae"], wanted["skill"], wanted["n_samples"])
    )
    columns = [F.col("region")]
    for m in models:
        columns += [F.col(f"{m}_mae").alias(f"mae_{m}"), F.col(f"{m}_skill").alias(f"skill_{m}")]
    columns.append(F.col(f"{models[0]}_n_samples").alias("n_samples"))
    return per.select(*columns)


def example_sample(samples: DataFrame) -> DataFrame:
    """The sample whose target prices spread the most (lowest id on ties)."""
    spread = F.array_max("y_price") - F.array_min("y_price")
    best = F.max_by(F.struct("sample_id", "node", "target_date"), F.struct(spread, -F.col("sample_id")))
    return samples.agg(best.alias("b")).select("b.*")


def parity(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Largest absolute difference of two prediction tables on shared rows."""
    pairs = left.alias("a").join(right.alias("b"), ["sample_id", "hora"])
    gap = F.max(F.abs(F.col("a.pml_pred") - F.col("b.pml_pred")))
    return pairs.agg(F.count("*").alias("n_rows"), gap.alias("max_abs_diff")).withColumn(
        "within", F.col("max_abs_diff") <= tolerance
    )
