"""Daily operation: forecasts for many nodes at once, scoring and recent skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import loomgrid
from loomgrid.config import ISSUE_HOUR, PUBLISH_HOUR, SeriesSpec, Settings
from loomgrid.operators import coverage, evaluate
from loomgrid.operators.grid import with_target_blocks
from loomgrid.operators.samples import build_samples
from loomgrid.operators.stats import block_partials
from loomgrid.schemas import FORECAST_COLUMNS, SCORE_COLUMNS

SYSTEM = "SIN"
TOP_HOURS = 4
CHEAP_HOURS = 4


def history_days(spec: SeriesSpec, settings: Settings) -> int:
    """Days before the origin a sample may read."""
    return (max(settings.input_blocks, settings.stats_blocks) + 1) * spec.block_days


def next_targets(
    silver: DataFrame, as_of: Column, spec: SeriesSpec, settings: Settings = Settings()
) -> DataFrame:
    """Furthest forecastable day per node at a moment, or why there is none.

    That is the day after the last stored one, as long as today's block is stored.
    ``newest`` is the day that should be published by then. Every stored node gets a
    row; ``last_day`` is null if its last day is beyond the history that a sample reads.
    """
    today = as_of.cast("date")
    horizon = F.date_add(today, spec.block_days)
    recent = (F.col("fecha") >= F.date_sub(today, history_days(spec, settings))) & (
        F.col("fecha") <= horizon
    )
    # two columns of the table are read; the maximum is combined before the shuffle
    last = silver.groupBy(*spec.keys).agg(
        F.max(F.when(recent, F.col("fecha"))).alias("last_day")
    )
    newest = F.when(F.hour(as_of) >= PUBLISH_HOUR, horizon).otherwise(today)
    fits = F.coalesce(F.col("last_day") >= today, F.lit(False))
    return last.select(
        *spec.keys,
        "last_day",
        newest.alias("newest"),
        F.coalesce(F.col("last_day") < newest, F.lit(True)).alias("is_late"),
        F.when(fits, F.date_add("last_day", spec.block_days)).alias("target_date"),
        F.when(~fits, "published history ends before today").alias("skip_reason"),
    )


def days_between(silver: DataFrame, days: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Silver rows near the days of a small relation ``(fecha)``, read by date range."""
    first = days.agg(F.min("fecha").alias("d")).scalar()
    last = days.agg(F.max("fecha").alias("d")).scalar()
    return silver.where(
        (F.col("fecha") >= F.date_sub(first, before)) & (F.col("fecha") <= F.date_add(last, after))
    )


def scope_reason(known: Column, sistema: Column, has_catalog: bool) -> Column:
    """Why an entity is out of scope; null when it is in, or no catalogue is loaded."""
    if not has_catalog:
        return F.lit(None).cast("string")
    return F.when(~known, "not in the catalogue").when(sistema != SYSTEM, "out of scope")


def request_samples(
    requests: DataFrame,
    silver: DataFrame,
    spec: SeriesSpec,
    settings: Settings = Settings(),
    catalog: DataFrame | None = None,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Samples of ``(node, target_date)`` requests, all nodes in one job.

    Only rows up to the target day are read and only values up to the origin reach
    the inputs; an unpublished target gets an empty placeholder block.
    """
    origins = requests.select(
        *spec.keys, F.date_sub("target_date", spec.block_days).alias("origin_date")
    ).distinct()
    # a handful of dates: one aggregate row lets the scan prune by date
    first, last = origins.agg(F.min("origin_date"), F.max("origin_date")).first()
    history = silver.where(
        (F.col("fecha") >= F.date_sub(F.lit(first), history_days(spec, settings)))
        & (F.col("fecha") <= F.date_add(F.lit(last), spec.block_days))
    ).join(origins.select(*spec.keys).distinct(), list(spec.keys), "left_semi")
    padded = with_target_blocks(history, origins, spec)
    samples = build_samples(padded, spec, settings, catalog, holidays)
    return samples.join(origins, [*spec.keys, "origin_date"], "left_semi")


def explain_requests(
    requests: DataFrame,
    samples: DataFrame,
    silver: DataFrame,
    as_of: Column,
    spec: SeriesSpec,
    settings: Settings = Settings(),
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Add ``skip_reason`` to every request, null where a sample exists."""
    keys = list(spec.keys)
    asked = requests.withColumn(
        "origin_date", F.date_sub("target_date", spec.block_days)
    )
    reach = history_days(spec, settings)
    near = days_between(
        silver, asked.select(F.col("origin_date").alias("fecha")), reach, spec.block_days
    )
    stored = near.select(*keys, "fecha").distinct()
    # requests are few; each is spread over the days it may read and matched by day
    days = asked.withColumn(
        "fecha",
        F.explode(
            F.sequence(
                F.date_sub("origin_date", reach), F.date_add("origin_date", spec.block_days)
            )
        ),
    )
    found = days.join(stored, [*keys, "fecha"], "left_semi").groupBy(*keys, "target_date").agg(
        F.max("fecha").alias("last_day")
    )
    ready = samples.select(*keys, "target_date", F.lit(True).alias("ready"))
    rows = asked.join(found, [*keys, "target_date"], "left").join(
        ready, [*keys, "target_date"], "left"
    )
    has_catalog = catalog is not None
    if has_catalog:
        facts = catalog.select("node", F.col("sistema").alias("own"), F.lit(True).alias("known"))
        rows = rows.join(facts, "node", "left")
        scope = scope_reason(F.coalesce("known", F.lit(False)), F.col("own"), True)
    else:
        scope = scope_reason(F.lit(True), F.lit(SYSTEM), False)
    far = F.col("target_date") > F.date_add(as_of.cast("date"), 2 * spec.block_days)
    reason = (
        F.when(far, "target out of range")
        .when(scope.isNotNull(), scope)
        .when(F.col("last_day").isNull(), "no published history")
        .when(F.col("last_day") < F.col("origin_date"), "history ends before the origin")
        .when(F.col("ready").isNull(), "too little clean history")
    )
    return rows.select(*keys, "origin_date", "target_date", reason.alias("skip_reason"))


def published_price(price: Column) -> Column:
    """Price of two decimals; of a half, as ten decimals show it, the even neighbour."""
    return F.bround(price.cast("decimal(28, 10)"), 2).cast("double")


def forecast_answers(
    predicted: DataFrame,
    silver: DataFrame,
    as_of: Column,
    spec: SeriesSpec,
    evaluated: DataFrame | None = None,
) -> DataFrame:
    """Forecasts with prices rounded to two decimals, best and cheapest block and audit fields."""
    keys = list(spec.keys)
    near = days_between(silver, predicted.select(F.col("target_date").alias("fecha")))
    published = near.select(*keys, F.col("fecha").alias("target_date")).distinct()
    rows = predicted.join(
        published.withColumn("backtest", F.lit(True)), [*keys, "target_date"], "left"
    ).withColumn("backtest", F.coalesce("backtest", F.lit(False)))
    if evaluated is None:
        rows = rows.withColumn("evaluated_node", F.lit(False))
    else:
        listed = evaluated.select("node").distinct().withColumn("evaluated_node", F.lit(True))
        rows = rows.join(listed, "node", "left").withColumn(
            "evaluated_node", F.coalesce("evaluated_node", F.lit(False))
        )
    replay = F.col("origin_date").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(ISSUE_HOUR)
    )
    end = F.date_add("origin_date", spec.block_days).cast("timestamp_ntz")
    hours = F.transform(
        "y_pred", lambda p, i: F.struct((i + 1).alias("hora"), published_price(p).alias("pml"))
    )
    return rows.select(
        *keys,
        *[c for c in ("sistema", "market") if c in rows.columns and c not in keys],
        "origin_date",
        "target_date",
        F.when(F.col("backtest"), replay).otherwise(as_of.cast("timestamp_ntz")).alias("issued_at"),
        (end - F.make_dt_interval(secs=F.lit(spec.step_seconds))).alias("history_end"),
        hours.alias("hours"),
        evaluate.block_window(F.col("y_pred"), TOP_HOURS, True).alias("best_window"),
        evaluate.block_window(F.col("y_pred"), CHEAP_HOURS, False).alias("cheapest_window"),
        F.lit(loomgrid.__version__).alias("model_version"),
        "backtest",
        "evaluated_node",
    )


def forecast_table(answers: DataFrame, run_at: Column | None = None) -> DataFrame:
    """Answers as the long daily forecast table."""
    rows = answers.select("*", F.inline("hours"))
    market = F.col("market") if "market" in answers.columns else F.lit("MDA")
    return rows.select(
        "node",
        market.alias("market"),
        "origin_date",
        "target_date",
        "hora",
        F.col("pml").alias("pml_pred"),
        "model_version",
        "issued_at",
        (F.current_timestamp() if run_at is None else run_at).alias("run_at"),
    ).select(*FORECAST_COLUMNS)


def replace_targets(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored forecasts with those of the freshly forecast days replaced."""
    days = fresh.select("target_date").distinct()
    kept = stored.join(days, "target_date", "left_anti")
    return kept.unionByName(fresh)


def score_published(
    forecasts: DataFrame,
    silver: DataFrame,
    spec: SeriesSpec,
    scored: DataFrame | None = None,
    settings: Settings = Settings(),
    scored_at: Column | None = None,
) -> DataFrame:
    """Scores of stored forecasts whose prices are complete and not scored yet.

    Each forecast looks up three blocks (its target, the block before and the one
    ``week_lag`` before) in a single join with the block rows.
    """
    keys = list(spec.keys)
    done = [*keys, "target_date"]
    if scored is not None:
        forecasts = forecasts.join(scored.select(*done).distinct(), done, "left_anti")
    step = F.struct("hora", "pml_pred")
    pending = forecasts.groupBy(*done).agg(F.array_sort(F.collect_list(step)).alias("p"))
    pending = pending.select(*done, F.transform("p", lambda s: s["pml_pred"]).alias("y_pred"))
    lags = {"actual": 0, "naive24": 1, "naive168": settings.week_lag}
    roles = [
        F.struct(
            F.lit(name).alias("role"),
            F.date_sub("target_date", lag * spec.block_days).alias("fecha"),
        )
        for name, lag in lags.items()
    ]
    needed = pending.select(*done, F.inline(F.array(*roles)))
    # only the blocks some forecast looks up are aggregated
    wanted = needed.select(*keys, "fecha").distinct()
    near = days_between(silver, wanted).join(wanted, [*keys, "fecha"], "left_semi")
    blocks = block_partials(near, spec, steps=True).where(F.col("n") == spec.steps_per_block)
    prices = F.transform("steps", lambda s: s["pml"])
    found = needed.join(blocks.select(*keys, "fecha", prices.alias("prices")), [*keys, "fecha"])
    wide = found.groupBy(*done).agg(
        *[F.max_by("prices", F.when(F.col("role") == r, 1)).alias(r) for r in lags]
    )
    rows = pending.join(wide.where(F.col("actual").isNotNull()), done)
    rows = evaluate.score(rows.withColumnRenamed("actual", "y_true"), settings.top_k)
    n = spec.steps_per_block
    mae = F.col("abs_sum") / n
    own24 = evaluate.absolute_error(F.col("y_true"), F.col("naive24")) / n
    own168 = evaluate.absolute_error(F.col("y_true"), F.col("naive168")) / n
    stamp = F.current_timestamp() if scored_at is None else scored_at
    return rows.select(
        *keys,
        "target_date",
        mae.alias("mae"),
        F.sqrt(F.col("sq_sum") / n).alias("rmse"),
        F.col("overlap").alias("top4_overlap"),
        F.col("captured").alias("captured_value"),
        own24.alias("naive24_mae"),
        own168.alias("naive168_mae"),
        evaluate.skill(mae, own24).alias("skill_vs_naive24"),
        stamp.alias("scored_at"),
    ).select(*dict.fromkeys([*keys, *SCORE_COLUMNS]))


def recent_skill(scores: DataFrame, days: int = 30) -> DataFrame:
    """Mean metrics over the last scored days (strictly after the last minus ``days``)."""
    last = scores.agg(F.max("target_date").alias("d")).scalar()
    recent = scores.where(F.col("target_date") > F.date_sub(last, days))
    return recent.agg(
        F.countDistinct("target_date").alias("days"),
        F.countDistinct("node").alias("nodes"),
        *[
            F.avg(c).alias(c)
            for c in ("mae", "top4_overlap", "captured_value", "skill_vs_naive24")
        ],
    )


def latest_scored(scores: DataFrame, node: str | None = None) -> DataFrame:
    """Newest scored forecast, of one node where given (smallest node on ties)."""
    rows = scores if node is None else scores.where(F.col("node") == node)
    columns = ["node", "target_date", "mae", "top4_overlap", "captured_value", "skill_vs_naive24"]
    return rows.orderBy(F.desc("target_date"), "node").limit(1).select(*columns)


def model_card(meta: DataFrame, scores: DataFrame, silver: DataFrame) -> DataFrame:
    """One row of facts shown next to a forecast: dataset, recent skill, freshness."""
    recent = recent_skill(scores)
    return meta.select(
        F.lit(loomgrid.__version__).alias("version"),
        F.col("name").alias("dataset"),
        F.size("nodes").alias("nodes"),
        "input_hours",
        F.col("silver_range.first_origin").alias("trained_from"),
        F.col("scaling.window_days").alias("scaling_days"),
        "splits",
        *[recent.select(c).scalar().alias(f"recent_{c}") for c in recent.columns],
        coverage.freshness(silver).scalar().alias("last_day"),
    )
