"""Block partials and trailing statistics frozen at the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.config import COMPONENTS, PRICES, SeriesSpec, Settings
from loomgrid.functions.scaling import floored_sigma
from loomgrid.operators.chunks import chunk_keys, with_halo, with_slots

#: sums of prices are kept in these parts, as whole numbers: they do not depend on the order of the rows,
#: so neither does a mean that lies half way between two rounded ones
UNIT = 10**8
COMPONENT_MEANS = {"pml_ene": "mu_ene", "pml_per": "mu_per", "pml_cng": "mu_cng"}


def mean_of(total: str, n: str) -> Column:
    """Mean price of a sum in whole parts, rounded once."""
    return F.col(total) / (F.col(n) * F.lit(float(UNIT)))


def block_partials(silver: DataFrame, spec: SeriesSpec, steps: bool = False) -> DataFrame:
    """One row per (series, block): counts, sums and spread of its steps.

    Trailing windows run on these rows instead of the steps, which are
    ``steps_per_block`` times more. ``steps=True`` also keeps the ordered steps of
    the block as an array (bounded by the block length).
    """
    rows = with_slots(silver, spec)
    carry = [c for c in ("market", "sistema") if c in rows.columns and c not in spec.keys]
    aggregates = [
        "min(fecha) AS fecha",
        *[f"max({c}) AS {c}" for c in carry],
        "count(*) AS n_rows",
        "count(pml) AS n",
        f"sum(CAST(round(pml * {UNIT}) AS DECIMAL(28, 0))) AS s",
        "var_pop(pml) * count(pml) AS m2",
        "max(pml) AS top",
        *[f"count({c}) AS n_{c}" for c in COMPONENTS],
        *[f"sum({c}) AS s_{c}" for c in COMPONENTS],
        "count_if(quality = 'missing') AS n_missing",
        "count_if(quality = 'interp') AS n_interp",
    ]
    if steps:
        extra = [c for c in ("is_holiday",) if c in rows.columns]
        step = ", ".join(["hora", "ts_local", *PRICES, "quality", *extra])
        aggregates.append(f"array_sort(collect_list(struct({step}))) AS steps")
    return rows.groupBy(*chunk_keys(spec), "block").agg(*map(F.expr, aggregates))


def frame(spec: SeriesSpec, first: int, last: int):
    """Window frame of blocks ``first``..``last`` relative to the current one."""
    return (
        Window.partitionBy(*chunk_keys(spec)).orderBy("block").rangeBetween(first, last)
    )


def trailing_stats(
    spec: SeriesSpec, settings: Settings, ending: int = 0
) -> dict[str, Column]:
    """Raw window sums over block partials that carry their halo.

    ``ending`` is the last block of the windows relative to the current one; -1
    gives the statistics frozen one block earlier.
    """
    over = f"OVER (PARTITION BY {', '.join(chunk_keys(spec))} ORDER BY block RANGE BETWEEN"

    def reach(blocks: int) -> str:
        last = f"{-ending} PRECEDING" if ending else "CURRENT ROW"
        return f"{over} {blocks - ending - 1} PRECEDING AND {last})"

    trail, recent = reach(settings.stats_blocks), reach(settings.input_blocks)
    # deviations from a level nearby (see with_pivot), so the squares stay small
    sums = {
        "t_n": f"sum(n) {trail}",
        "t_s": f"sum(s) {trail}",
        "t_m2": f"sum(m2) {trail}",
        "t_d2": f"sum(n * pow(IF(n > 0, s / (n * {UNIT}D), NULL) - pivot, 2)) {trail}",
        **{f"t_n_{c}": f"sum(n_{c}) {trail}" for c in COMPONENTS},
        **{f"t_s_{c}": f"sum(s_{c}) {trail}" for c in COMPONENTS},
        "r_n": f"sum(n) {recent}",
        "r_s": f"sum(s) {recent}",
    }
    return {name: F.expr(text) for name, text in sums.items()}


def with_pivot(blocks: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Level of the first known block of each chunk, the reference of its deviations.

    It lies at or before every window that uses it, so later values cannot reach
    the statistics even through rounding.
    """
    so_far = Window.partitionBy(*chunk_keys(spec)).orderBy("block").rowsBetween(
        Window.unboundedPreceding, 0
    )
    level = F.when(F.col("n") > 0, mean_of("s", "n"))
    return blocks.withColumn("pivot", F.first(level, ignorenulls=True).over(so_far))


def finish_stats(df: DataFrame, spec: SeriesSpec, settings: Settings) -> DataFrame:
    """Turn raw window sums into ``mu, std_raw, sigma, n_obs, mu_7d, mu_*, valid``."""
    need = settings.min_observations(spec)
    enough = F.col("t_n") >= need
    mu = mean_of("t_s", "t_n")
    offset = mu - F.col("pivot")
    spread = F.col("t_m2") + F.col("t_d2") - F.col("t_n") * offset * offset
    std = F.sqrt(F.greatest(spread, F.lit(0.0)) / F.col("t_n"))
    return df.withColumns(
        {
            "mu": F.when(enough, mu),
            "std_raw": F.when(enough, std),
            "sigma": F.when(enough, floored_sigma(std, mu, settings)),
            "n_obs": F.when(enough, F.col("t_n")),
            "mu_7d": F.when(F.col("r_n") >= 1, mean_of("r_s", "r_n")),
            **{
                name: F.when(F.col(f"t_n_{c}") >= need, F.col(f"t_s_{c}") / F.col(f"t_n_{c}"))
                for c, name in COMPONENT_MEANS.items()
            },
            "valid": F.coalesce(enough, F.lit(False)),
        }
    )


STAT_COLUMNS = [
    "mu",
    "std_raw",
    "sigma",
    "n_obs",
    "mu_7d",
    "mu_ene",
    "mu_per",
    "mu_cng",
    "valid",
]


def rolling_stats(
    silver: DataFrame, spec: SeriesSpec, settings: Settings = Settings()
) -> DataFrame:
    """Scaling statistics of every origin block of a gap-free grid.

    The trailing window ends with the origin block; missing steps are left out.
    ``mu`` and ``sigma`` are null until the window holds enough observations.
    """
    reach = max(settings.stats_blocks, settings.input_blocks) - 1
    blocks = with_halo(block_partials(silver, spec), spec, before=reach, after=0)
    raw = with_pivot(blocks, spec).withColumns(trailing_stats(spec, settings))
    out = finish_stats(raw.where("core"), spec, settings)
    return out.select(*spec.keys, F.col("fecha").alias("origin"), *STAT_COLUMNS)
