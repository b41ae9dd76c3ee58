"""Every operator as a query over the given tables."""

from __future__ import annotations

import datetime
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import calendar, clock, encoding, scaling
from loomgrid.operators import (
    cleaning,
    coverage,
    effects,
    evaluate,
    grid,
    planning,
    quality,
    samples,
    splits,
    stats,
)
from loomgrid.operators.forecasters import (
    RIDGE_ALPHAS,
    BatchScorer,
    RidgeLags,
    SeasonalMA,
    collect_grams,
    gram_table,
    predict_linear,
    solve_ridge,
)
from loomgrid.plans import baselines, daily, dataset, selection
from loomgrid.session import configure, stage, stage_dir
from loomgrid.sources import bronze, catalog, silver
from loomgrid.streaming import ingest
from workload import series
from workload.series import (
    HOURLY,
    HOURLY_SETTINGS,
    MONTHLY,
    MONTHLY_SETTINGS,
    WEEKLY,
    WEEKLY_SETTINGS,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MIDDLE = datetime.date(2024, 1, 15)
AS_OF = datetime.datetime(2001, 10, 8, 9, 0, 0)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(function(configure(spark), sf_dir))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return run


def tidy(df: DataFrame) -> DataFrame:
    """Plain output types: BIGINT, rounded DOUBLE, DATE and VARCHAR."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("int", "smallint", "bigint", "boolean"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.round(c, 6)
        elif kind == "float":
            c = F.round(c.cast("double"), 4)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


# --- series shared by the queries ------------------------------------------------


def hourly_silver(spark, sf, max_interp: int = HOURLY_SETTINGS.max_interp) -> DataFrame:
    return grid.build_grid(series.event_hours(spark, sf), HOURLY, max_interp)


def weekly_silver(spark, sf) -> DataFrame:
    return grid.build_grid(series.ship_days(spark, sf), WEEKLY, WEEKLY_SETTINGS.max_interp)


def monthly_silver(spark, sf) -> DataFrame:
    return grid.build_grid(series.nation_weeks(spark, sf), MONTHLY, MONTHLY_SETTINGS.max_interp)


def weekly_samples(spark, sf) -> DataFrame:
    """Labelled weekly samples without the model inputs, written once and read back."""
    built = samples.build_samples(
        weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS, sequences=False
    )
    kept = stage(built.drop("z_pml", "X_cal", "X_level", "region_onehot", "y", "comp_mu"))
    return splits.assign_splits(kept, WEEKLY_SETTINGS)


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "UNKNOWN")


def monthly_samples(spark, sf) -> DataFrame:
    built = samples.build_samples(
        monthly_silver(spark, sf),
        MONTHLY,
        MONTHLY_SETTINGS,
        series.nation_catalog(spark, sf),
        series.order_holidays(spark, sf),
        regions=REGIONS,
        sequences=False,
    )
    return splits.assign_splits(stage(built.drop("z_pml")), MONTHLY_SETTINGS)


def monthly_dataset(spark, sf) -> dataset.Dataset:
    return dataset.build_dataset(
        monthly_silver(spark, sf),
        series.nation_catalog(spark, sf),
        "monthly",
        MONTHLY,
        MONTHLY_SETTINGS,
        holidays=series.order_holidays(spark, sf),
        regions=REGIONS,
        sequences=False,
    )


def naive_forecasts(rows: DataFrame) -> DataFrame:
    """Both naive forecasts of every sample as ``(model_name, y_true, y_pred, y_ref)``."""
    pairs = F.array(
        F.struct(F.lit("naive24").alias("model_name"), F.col("last_block").alias("y_pred")),
        F.struct(F.lit("naive168").alias("model_name"), F.col("week_block").alias("y_pred")),
    )
    keep = [c for c in ("region", "zone", "split") if c in rows.columns]
    return rows.select(
        "node",
        "block",
        "origin_date",
        "target_date",
        "is_spike_day",
        *keep,
        F.col("y_price").alias("y_true"),
        F.col("week_block").alias("y_ref"),
        F.inline(pairs),
    )


def long_steps(df: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select(*keys, F.posexplode(zipped).alias("at", "z")).select(
        *keys, (F.col("at") + 1).alias("hora"), *[F.col(f"z.{n}").alias(n) for n in arrays]
    )


# --- cleaning and grids ----------------------------------------------------------


@query
def hourly_grid(spark, sf):
    return hourly_silver(spark, sf).select(
        "node", "ts_local", "fecha", "hora", "pml", "pml_ene", "quality"
    )


@query
def hourly_interpolation(spark, sf):
    return hourly_silver(spark, sf, 3).where("quality = 'interp'").select(
        "node", "ts_local", "pml", "pml_ene"
    )


@query
def weekly_block_grid(spark, sf):
    return weekly_silver(spark, sf).select("node", "ts_local", "fecha", "hora", "pml", "quality")


@query
def gap_runs(spark, sf):
    return grid.gap_table(hourly_silver(spark, sf), HOURLY)


@query
def gap_headline(spark, sf):
    gaps = grid.gap_table(monthly_silver(spark, sf), MONTHLY)
    return quality.gap_headline(gaps)


@query
def record_dedup(spark, sf):
    """Events as price records of an hour; the last event of the hour is kept."""
    events = table(spark, sf, "events")
    records = events.select(
        F.col("event_type").alias("node"),
        F.col("ts").cast("date").alias("fecha"),
        (F.hour("ts") + 1).alias("hora"),
        F.col("value").alias("pml"),
        "event_id",
    )
    rows = cleaning.records_to_hourly(records, HOURLY, ["event_id"])
    return rows.select(
        "node", "market", "sistema", "ts_local", "fecha", "hora", "pml", "quality", "source_hora"
    )


def shipped_hours(spark, sf) -> DataFrame:
    """Mean price of the line items in the hours of their shipping day.

    Every item takes as many of the day's hours in a row, wrapping around, as its quantity
    modulo eight and one more. Sums are combined before the shuffle, in whole cents.
    """
    items = table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    start = F.col("l_orderkey") + 5 * F.col("l_linenumber")
    more = (F.col("l_quantity") % 8).cast("bigint")
    spread = items.select(
        day.alias("fecha"),
        calendar.day_hours(day).cast("bigint").alias("hours"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.explode(F.sequence(start, start + more)).alias("at"),
    )
    return spread.groupBy("fecha", (F.pmod("at", "hours") + 1).cast("int").alias("hora")).agg(
        F.sum("cents").alias("cents"), F.count("*").alias("n")
    )


def shipped_records(spark, sf) -> DataFrame:
    price = F.col("cents") / F.col("n") / 100
    return shipped_hours(spark, sf).select(
        F.lit("ALL").alias("node"),
        "fecha",
        "hora",
        price.alias("pml"),
        (price * 0.9).alias("pml_ene"),
        (price * 0.05).alias("pml_per"),
        (price * 0.05).alias("pml_cng"),
        F.lit(0).alias("arrival"),
    )


@query
def daylight_saving_align(spark, sf):
    rows = cleaning.records_to_hourly(shipped_records(spark, sf), HOURLY, ["arrival"])
    return rows.select(
        "node", "ts_local", "fecha", "hora", "pml", "pml_ene", "quality", "source_hora"
    )


@query
def daylight_saving_rows(spark, sf):
    rows = cleaning.records_to_hourly(shipped_records(spark, sf), HOURLY, ["arrival"])
    return quality.dst_rows(grid.build_grid(rows, HOURLY), HOURLY)


@query
def silver_merge(spark, sf):
    """Hourly means up to a day merged with later hourly maxima; stored rows win."""
    events = table(spark, sf, "events")
    node, ts, value = F.col("event_type"), F.col("ts"), F.col("value")
    old = series._observed(events.where("ts < '2024-01-20'"), node, ts, value, HOURLY)
    slot = clock.slot_of(ts, HOURLY)
    top = events.where("ts >= '2024-01-10'").groupBy(node, slot.alias("s")).agg(
        F.max("value").alias("value")
    )
    new = series._observed(
        top.withColumn("ts", clock.ts_of_slot(F.col("s"), HOURLY)), node, ts, value, HOURLY
    )
    merged = silver.merge_observed(old, new, HOURLY, HOURLY_SETTINGS.max_interp)
    return merged.select("node", "ts_local", "pml", "quality")


def arrivals(spark, sf) -> list[DataFrame]:
    """Hourly means as three arrivals of rows: days up to the middle but for some that come late, the days
    around the middle told anew and a little higher, then the late days and all others."""
    rows = series.event_hours(spark, sf)
    late = F.dayofmonth("fecha") % 5 == 0
    first = (F.col("fecha") <= MIDDLE) & ~late
    again = F.col("fecha").between(F.date_sub(F.lit(MIDDLE), 2), F.date_add(F.lit(MIDDLE), 5)) & ~late
    told = [c for c in ("pml", "pml_ene", "pml_per", "pml_cng")]
    return [
        rows.where(first),
        rows.where(again).withColumns({c: F.col(c) + 1 for c in told}),
        rows.where(late | (F.col("fecha") > MIDDLE)),
    ]


def envelopes_of(rows: DataFrame) -> DataFrame:
    """One answer of the service for each series and day."""
    told = F.struct(
        F.col("fecha").cast("string").alias("fecha"),
        F.col("hora").cast("string").alias("hora"),
        *[F.col(c).cast("string").alias(c) for c in ("pml", "pml_ene", "pml_per", "pml_cng")],
    )
    days = rows.groupBy("node", "fecha").agg(F.array_sort(F.collect_list(told)).alias("Valores"))
    result = F.array(F.struct(F.col("node").alias("clv_nodo"), "Valores"))
    return days.select(
        F.lit("SIN").alias("sistema"),
        F.lit("MDA").alias("proceso"),
        F.to_json(F.struct(result.alias("Resultados"))).alias("body"),
    )


def ingested(spark, sf, after=None) -> str:
    """Silver folder after a stream has run to its end behind each arrival."""
    root = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    for number, rows in enumerate(arrivals(spark, sf)):
        envelopes_of(rows).write.json(f"{root}/bronze/arrival-{number}")
        run = ingest.ingest(
            spark,
            f"{root}/bronze",
            f"{root}/silver",
            f"{root}/state",
            max_interp=HOURLY_SETTINGS.max_interp,
            buckets=4,
            after=None if after is None else functools.partial(after, root),
        )
        run.awaitTermination()
    return root


@query
def stream_silver(spark, sf):
    """Silver after the stream of three arrivals, one of them a replay with other prices, one late."""
    stored = silver.read_silver(spark, f"{ingested(spark, sf)}/silver")
    return stored.select("node", "ts_local", "pml", "quality")


@query
def stream_scores(spark, sf):
    """Errors of the day before as a forecast, as known after each batch of the stream."""

    def score(root: str, batch: DataFrame, batch_id: int) -> None:
        known = silver.read_silver(batch.sparkSession, f"{root}/silver").where("quality = 'ok'")
        before = known.select(
            "node", (F.col("ts_local") + F.make_dt_interval(F.lit(1))).alias("ts_local"), F.col("pml").alias("forecast")
        )
        # whole parts of a price, so that the order of the rows plays no part
        parts = F.round(F.abs(F.col("pml") - F.col("forecast")) * stats.UNIT).cast("bigint")
        errors = known.join(before, ["node", "ts_local"]).groupBy("node").agg(
            F.count("*").alias("n"), (F.sum(parts) / (F.count("*") * F.lit(float(stats.UNIT)))).alias("mae")
        )
        # a replayed batch writes its own folder again
        errors.write.mode("overwrite").parquet(f"{root}/scores/batch={batch_id}")

    root = ingested(spark, sf, score)
    return spark.read.parquet(f"{root}/scores").select(F.col("batch").alias("batch_id"), "node", "n", "mae")


@query
def silver_upserts(spark, sf):
    """Silver after upserts of three arrivals, the second of them twice."""
    path = f"{stage_dir(spark)}/upserts-{uuid.uuid4().hex}"
    first, again, late = arrivals(spark, sf)
    for rows in (first, again, again, late):
        silver.upsert_silver(spark, path, rows, max_interp=HOURLY_SETTINGS.max_interp, buckets=4)
    return silver.read_silver(spark, path).select("node", "ts_local", "pml", "quality")


@query
def silver_pruned(spark, sf):
    """Two series of a stored table between two days, read by node, date and column."""
    path = f"{stage_dir(spark)}/pruned-{uuid.uuid4().hex}"
    silver.upsert_silver(spark, path, series.event_hours(spark, sf), max_interp=HOURLY_SETTINGS.max_interp, buckets=4)
    return silver.read_silver(
        spark, path, nodes=["click", "error"], start="2024-01-05", end="2024-01-11", columns=["node", "ts_local", "pml"], buckets=4
    )


# --- coverage and quality --------------------------------------------------------


@query
def coverage_pairs(spark, sf):
    return coverage.complete_blocks(hourly_silver(spark, sf), HOURLY)


@query
def coverage_table(spark, sf):
    return coverage.coverage_table(hourly_silver(spark, sf), HOURLY)


@query
def coverage_quality(spark, sf):
    return coverage.coverage_summary(hourly_silver(spark, sf), HOURLY)


@query
def price_levels(spark, sf):
    return quality.price_levels(hourly_silver(spark, sf), HOURLY)


@query
def price_profile(spark, sf):
    rows = monthly_silver(spark, sf).join(
        series.nation_catalog(spark, sf).select("node", "region"), "node"
    )
    return quality.price_profile(rows, ["region", "node"])


@query
def nonpositive_share(spark, sf):
    return quality.nonpositive_headline(quality.price_levels(weekly_silver(spark, sf), WEEKLY))


@query
def spike_years(spark, sf):
    return quality.spike_summary(weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS)


@query
def spike_pivot(spark, sf):
    spikes = quality.spike_summary(weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS)
    wide = quality.spike_pivot(spikes, WEEKLY)
    return wide.select("node", *[F.col(y).alias(f"y{y}") for y in wide.columns if y.isdigit()])


@query
def sigma_distribution(spark, sf):
    rows = stats.rolling_stats(monthly_silver(spark, sf), MONTHLY, MONTHLY_SETTINGS)
    return quality.sigma_distribution(rows, MONTHLY_SETTINGS)


@query
def freshness(spark, sf):
    return coverage.freshness(hourly_silver(spark, sf))


@query
def trailing_extract(spark, sf):
    rows = coverage.trailing_days(hourly_silver(spark, sf), 10, ["click", "error", "view"])
    return rows.select("node", "ts_local", "pml", "quality")


# --- statistics and features -----------------------------------------------------


@query
def rolling_stats(spark, sf):
    rows = stats.rolling_stats(weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS)
    return rows.select("node", "origin", "mu", "std_raw", "sigma", "n_obs", "mu_7d", "valid")


@query
def rolling_stats_hourly(spark, sf):
    return stats.rolling_stats(hourly_silver(spark, sf), HOURLY, HOURLY_SETTINGS)


@query
def level_features(spark, sf):
    rows = stats.rolling_stats(weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS).where("valid")
    args = (F.col("mu"), F.col("sigma"), F.col("mu_7d"))
    plain = scaling.level_features(*args, "sigma_over_1000")
    logged = scaling.level_features(*args, "log1p_sigma")
    return rows.select(
        "node",
        "origin",
        plain[0].alias("mu_over_1000"),
        plain[1].alias("sigma_over_1000"),
        logged[1].alias("log1p_sigma"),
        plain[2].alias("trend_7d"),
    )


@query
def sequence_calendar(spark, sf):
    rows = hourly_silver(spark, sf).withColumn("day", F.col("fecha"))
    urgent = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n")
    )
    holidays = urgent.where("errors * 5 > n").select("date")
    rows = calendar.flag_holidays(rows, holidays, "day", "holiday")
    parts = calendar.sequence_calendar(F.col("ts_local"), F.col("holiday"))
    return rows.select(
        "node", "ts_local", *[p.alias(n) for p, n in zip(parts, calendar.SEQ_CALENDAR)]
    )


@query
def target_calendar(spark, sf):
    rows = monthly_samples(spark, sf)
    return rows.select(
        "node",
        "target_date",
        *[F.get("X_cal", F.lit(i)).alias(n) for i, n in enumerate(calendar.TARGET_CALENDAR)],
    )


@query
def season_counts(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    near = calendar.circular_doy_distance(F.dayofyear("d"), F.lit(1)) <= 15
    return days.groupBy(calendar.season_of(F.col("d")).alias("season")).agg(
        F.count("*").alias("n"), F.count_if(near).alias("near_new_year")
    )


@query
def text_normalize(spark, sf):
    parts = table(spark, sf, "part")
    label = F.concat_ws(
        "  ", F.translate("p_name", "aeiou", "áéíóú"), F.lower("p_type"), F.col("p_brand")
    )
    return parts.select("p_partkey", encoding.normalize_text(label).alias("label"))


# --- samples, splits and folds ---------------------------------------------------


@query
def valid_origins(spark, sf):
    return samples.valid_origins(hourly_silver(spark, sf), HOURLY, HOURLY_SETTINGS)


@query
def valid_origins_weekly(spark, sf):
    return samples.valid_origins(weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS)


@query
def whole_blocks(spark, sf):
    """Series of the raw hours that are not a gap-free grid."""
    return samples.assert_whole_blocks(series.event_hours(spark, sf), HOURLY).select(
        "node", "n_steps"
    )


@query
def sample_index(spark, sf):
    return weekly_samples(spark, sf).select(
        "node",
        "origin_date",
        "target_date",
        "split",
        "is_spike_day",
        "n_interp_input",
        "mu",
        "sigma",
        "std_raw",
        "mu_7d",
    )


@query
def split_bounds(spark, sf):
    built = samples.build_samples(weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS)
    return splits.split_bounds(built, WEEKLY_SETTINGS)


@query
def samples_long(spark, sf):
    built = samples.build_samples(hourly_silver(spark, sf), HOURLY, HOURLY_SETTINGS)
    steps = built.select("node", "origin_date", F.posexplode("X_seq").alias("step", "x"))
    names = dataset.SEQ_FEATURES
    return steps.select(
        "node",
        "origin_date",
        "step",
        *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)],
    )


@query
def target_prices(spark, sf):
    """Standardised targets and the prices recovered from them."""
    built = samples.build_samples(hourly_silver(spark, sf), HOURLY, HOURLY_SETTINGS)
    z = scaling.standardize_array(F.col("y_price"), F.col("mu"), F.col("sigma"))
    rows = built.withColumn("z", z).withColumn(
        "back", scaling.invert_array(F.col("z"), F.col("mu"), F.col("sigma"))
    )
    return long_steps(rows, ["node", "target_date"], z="z", price="back")


@query
def samples_arrays(spark, sf):
    """Array shapes of every sample."""
    built = samples.build_samples(weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS)
    return built.select(
        "node",
        "origin_date",
        F.size("X_seq").alias("steps"),
        F.size(F.get("X_seq", F.lit(0))).alias("features"),
        F.size("X_cal").alias("n_cal"),
        F.size("X_level").alias("n_level"),
        F.size("y").alias("n_target"),
        F.size("comp_mu").alias("n_comp"),
    )


@query
def dataset_index(spark, sf):
    """Dense ids, encoded metadata and labels of the assembled dataset."""
    ds = monthly_dataset(spark, sf)
    return ds.samples.select(
        "sample_id",
        "node",
        "region",
        "zone",
        "kv",
        "origin_date",
        "split",
        "zone_idx",
        "node_idx",
        F.element_at("X_meta", -1).alias("voltage_z"),
        F.array_position(F.slice("X_meta", 1, len(REGIONS)), F.lit(1.0).cast("float")).alias(
            "region_position"
        ),
    )


@query
def dataset_facts(spark, sf):
    ds = monthly_dataset(spark, sf)
    return ds.meta.select(
        "input_hours",
        "target_hours",
        F.size("nodes").alias("nodes"),
        F.size("train_nodes").alias("train_nodes"),
        F.size("zone_vocab").alias("zones"),
        "voltage_log_mean",
        "voltage_log_std",
        F.col("splits.train_end").alias("train_end"),
        F.col("splits.test_start").alias("test_start"),
        F.col("silver_range.first_origin").alias("first_origin"),
        F.col("silver_range.last_target").alias("last_target"),
        F.col("n_samples.train").alias("n_train"),
        F.col("n_samples.val").alias("n_val"),
        F.col("n_samples.test").alias("n_test"),
    )


def train_nodes(spark, sf) -> DataFrame:
    rows = monthly_samples(spark, sf).where("split = 'train'")
    return rows.select("node", "zone", "kv").distinct()


@query
def zone_vocabulary(spark, sf):
    return encoding.zone_vocabulary(train_nodes(spark, sf))


@query
def voltage_scaler(spark, sf):
    return encoding.voltage_scaler(train_nodes(spark, sf))


@query
def walk_forward(spark, sf):
    return splits.target_days(weekly_samples(spark, sf), "test")


@query
def sample_positions(spark, sf):
    """Samples per split of the nodes of two regions."""
    rows = monthly_samples(spark, sf)
    wanted = series.nation_catalog(spark, sf).where(F.col("region").isin("ASIA", "EUROPE"))
    ds = dataset.Dataset(rows, wanted, MONTHLY, MONTHLY_SETTINGS)
    return ds.positions(nodes=wanted).groupBy("split", "node").agg(F.count("*").alias("n"))


@query
def zone_dropout(spark, sf):
    """Zone indices with a share replaced by UNKNOWN at random."""
    rows = encoding.encode_zone(
        monthly_samples(spark, sf), encoding.zone_vocabulary(train_nodes(spark, sf))
    )
    kept = splits.zone_dropout(rows, 0.25, 0, ("node", "origin_date"))
    return kept.select("node", "origin_date", "zone_idx")


@query
def node_folds(spark, sf):
    return splits.node_folds(monthly_samples(spark, sf), 10)


@query
def zone_folds(spark, sf):
    return splits.zone_folds(monthly_samples(spark, sf))


@query
def fold_sizes(spark, sf):
    rows = monthly_samples(spark, sf)
    return splits.fold_counts(rows, splits.node_folds(rows), "node")


@query
def fold_roles(spark, sf):
    rows = monthly_samples(spark, sf)
    roles = splits.fold_roles(rows, splits.zone_folds(rows), "zone")
    return roles.select("held_out", "role", "node", "origin_date")


# --- forecasters and evaluation --------------------------------------------------


@query
def naive24(spark, sf):
    rows = weekly_samples(spark, sf)
    return long_steps(rows, ["node", "target_date"], pred="last_block", actual="y_price")


@query
def naive168(spark, sf):
    rows = weekly_samples(spark, sf)
    return long_steps(rows, ["node", "target_date"], pred="week_block", actual="y_price")


@query
def seasonal_ma(spark, sf):
    rows = weekly_samples(spark, sf)
    model = SeasonalMA(WEEKLY).fit(rows, weekly_silver(spark, sf))
    predicted = model.predict(rows.where("split = 'test'"))
    hours = long_steps(predicted, ["node", "target_date"], pred="y_pred")
    # halves as eight decimals show them: products of two means agree so far whatever the order of sums
    return hours.withColumn("pred", F.round(F.col("pred").cast("decimal(28, 8)"), 6).cast("double"))


@query
def ridge_lags(spark, sf):
    """Test forecasts of the ridge regression fitted on train and val."""
    ds = monthly_dataset(spark, sf)
    model = RidgeLags(MONTHLY, MONTHLY_SETTINGS).fit(ds.samples)
    predicted = model.predict(ds.positions("test"))
    return long_steps(predicted, ["sample_id", "node", "target_date"], pred="y_pred")


def block_design(rows: DataFrame, *keys: str) -> DataFrame:
    """The last block and the target block of samples, standardised, as inputs and targets."""

    def z(prices: str):
        return F.transform(prices, lambda p: (p - F.col("mu")) / F.col("sigma"))

    return rows.select(*keys or ("split",), z("last_block").alias("x"), z("y_price").alias("t"))


@query
def ridge_gram(spark, sf):
    """Cross products of the inputs and targets of all samples, by split."""
    n = WEEKLY.steps_per_block
    sums = gram_table(block_design(weekly_samples(spark, sf)), ["split"], n, n)
    cells = sums.select("split", F.col("row").alias("i"), F.posexplode("cells").alias("j", "total"))
    return cells.where("j >= i")


def normal_residual(rows: DataFrame, alpha: float, coef, intercept) -> DataFrame:
    """(target, n, residual): how far a fit on ``rows (x, t)`` is from solving its normal equations.

    Worked out from the samples, without the matrix that the fit was solved from.
    """
    told = predict_linear(rows.select("x", "t"), [(coef, intercept)])
    left = F.zip_with("t", F.col("z_hats")[0], lambda t, z: t - z)
    told = stage(told.select("x", left.alias("left")), "left")
    targets = range(coef.shape[1])
    # every sample has every input, so the sums over an input's rows are those over all samples
    products = told.select(F.posexplode("x").alias("i", "v"), "left").groupBy("i").agg(
        F.count("*").alias("n"),
        F.sum("v").alias("v"),
        *[F.sum(F.col("left")[j]).alias(f"s{j}") for j in targets],
        *[F.sum(F.col("v") * F.col("left")[j]).alias(f"p{j}") for j in targets],
    )
    # as many rows as inputs
    weights = rows.sparkSession.createDataFrame([(i, w) for i, w in enumerate(coef.tolist())], "i int, w array<double>")
    both = products.join(weights, "i")
    parts = [
        F.struct(
            F.lit(j + 1).alias("target"),
            "n",
            F.greatest(
                F.abs(F.col(f"p{j}") - F.col("v") / F.col("n") * F.col(f"s{j}") - alpha * F.col("w")[j]), F.abs(f"s{j}")
            ).alias("gap"),
        )
        for j in targets
    ]
    cells = both.select(F.explode(F.array(*parts)).alias("c")).select("c.*")
    return cells.groupBy("target", "n").agg((F.max("gap") / F.first("n")).alias("residual"))


@query
def ridge_normal_residual(spark, sf):
    """Normal equations of the ridge regression on train and val, at its penalty: one row per target."""
    ds = monthly_dataset(spark, sf)
    model = RidgeLags(MONTHLY, MONTHLY_SETTINGS).fit(ds.samples)
    rows = model.design(ds.samples.where(F.col("split").isin("train", "val")))
    return normal_residual(rows, model.alpha, model.coef, model.intercept)


@query
def ridge_penalties(spark, sf):
    """Normal equations of every penalty that is tried, on the training samples: a row per penalty and target."""
    rows = stage(block_design(weekly_samples(spark, sf)).where("split = 'train'"), "design")
    n = WEEKLY.steps_per_block
    train = collect_grams(gram_table(rows, ["split"], n, n), ["split"])[("train",)]
    found = []
    for alpha in RIDGE_ALPHAS:
        solved = normal_residual(rows, alpha, *solve_ridge(train, n, alpha))
        found.append(solved.withColumn("alpha", F.lit(float(alpha))))
    return functools.reduce(DataFrame.unionByName, found)


@query
def batch_scoring(spark, sf):
    """A supplied model that repeats the last standardised block of the window."""
    n = WEEKLY.steps_per_block

    def load():
        return lambda seq, cal, level: seq[:, -n:, 0]

    rows = samples.build_samples(weekly_silver(spark, sf), WEEKLY, WEEKLY_SETTINGS)
    predicted = BatchScorer(load, "repeat_last").predict(rows)
    # inputs are single precision, so the prices come back to a few parts in a million
    share = F.zip_with("y_pred", "last_block", lambda p, v: F.round(p / v, 3))
    return long_steps(predicted.withColumn("share", share), ["node", "target_date"], share="share")


@query
def predictions_table(spark, sf):
    rows = weekly_samples(spark, sf).where("split = 'test'")
    ids = rows.withColumn("sample_id", F.xxhash64("node", "block"))
    forecasts = baselines.forecast_rows(ids.withColumn("y_pred", F.col("last_block")), "naive24")
    out = baselines.predictions_table(forecasts)
    return out.select(
        "node", "market", "origin_date", "target_date", "hora", "pml_pred", "pml_actual",
        "model_name", "issued_at", "split",
    )


def weekly_scored(spark, sf) -> DataFrame:
    rows = naive_forecasts(weekly_samples(spark, sf).where("split = 'test'"))
    return evaluate.score(rows, WEEKLY_SETTINGS.top_k, "y_ref")


def monthly_scored(spark, sf) -> DataFrame:
    return evaluate.score(
        naive_forecasts(monthly_samples(spark, sf)), MONTHLY_SETTINGS.top_k, "y_ref"
    )


@query
def eval_metrics(spark, sf):
    return evaluate.metrics_by(weekly_scored(spark, sf), ["model_name"])


@query
def eval_subsets(spark, sf):
    rows = naive_forecasts(weekly_samples(spark, sf))
    scored = evaluate.score(rows, WEEKLY_SETTINGS.top_k, "y_ref")
    return evaluate.summarize(scored, ["model_name"])


@query
def eval_by_region(spark, sf):
    return evaluate.metrics_by(monthly_scored(spark, sf), ["model_name", "region"])


@query
def eval_region_table(spark, sf):
    return evaluate.region_table(monthly_scored(spark, sf), ["naive24", "naive168"])


@query
def eval_by_hour(spark, sf):
    rows = naive_forecasts(weekly_samples(spark, sf))
    return evaluate.mae_by_hour(rows, ["model_name"])


@query
def eval_flat_metrics(spark, sf):
    summary = evaluate.summarize(weekly_scored(spark, sf), ["model_name"])
    return evaluate.flat_metrics(summary, ["model_name"])


@query
def eval_summary_table(spark, sf):
    return baselines.summary_table(
        evaluate.summarize(weekly_scored(spark, sf), ["model_name"])
    )


@query
def top_overlap(spark, sf):
    return weekly_scored(spark, sf).select("model_name", "node", "target_date", "overlap")


@query
def captured_value(spark, sf):
    return weekly_scored(spark, sf).select("model_name", "node", "target_date", "captured")


@query
def block_windows(spark, sf):
    rows = weekly_samples(spark, sf)
    best = evaluate.block_window(F.col("y_price"), 3, True)
    low = evaluate.block_window(F.col("y_price"), 3, False)
    return rows.select(
        "node",
        "target_date",
        best["start_hour"].alias("best_start"),
        best["end_hour"].alias("best_end"),
        low["start_hour"].alias("low_start"),
        low["end_hour"].alias("low_end"),
    )


@query
def example_sample(spark, sf):
    ds = monthly_dataset(spark, sf)
    return evaluate.example_sample(ds.positions("test"))


@query
def prediction_parity(spark, sf):
    rows = weekly_samples(spark, sf).withColumn("sample_id", F.concat_ws("-", "node", "block"))
    left = long_steps(rows, ["sample_id"], pml_pred="last_block")
    right = long_steps(rows, ["sample_id"], pml_pred="week_block")
    return evaluate.parity(left, right, 1.0)


@query
def model_comparison(spark, sf):
    """Headline metrics of both naive forecasts on one daily series of all shipments."""
    rows = series.ship_days(spark, sf, F.lit("ALL"))
    built = samples.build_samples(
        grid.build_grid(rows, WEEKLY, WEEKLY_SETTINGS.max_interp), WEEKLY, WEEKLY_SETTINGS
    )
    scored = evaluate.score(naive_forecasts(built), WEEKLY_SETTINGS.top_k, "y_ref")
    return evaluate.metrics_by(scored, ["model_name"])


# --- model selection -------------------------------------------------------------


@query
def parameter_search(spark, sf):
    return selection.search(monthly_dataset(spark, sf), [0.1, 1.0, 10.0])


@query
def holdout_zones(spark, sf):
    return selection.holdout(monthly_dataset(spark, sf), "zone")


@query
def holdout_nodes(spark, sf):
    """Errors on held-out nodes and on held-out zones, of all kinds, from stored forecasts."""
    forecasts = stage(selection.holdout_forecasts(monthly_dataset(spark, sf)), "forecasts")
    return selection.fold_errors(forecasts, MONTHLY_SETTINGS.top_k)


@query
def effect_sums(spark, sf):
    """Sums of the inputs and targets of the training samples of every node, by cell."""
    n = WEEKLY.steps_per_block
    rows = weekly_samples(spark, sf).where("split = 'train'")
    labelled = block_design(rows, "node")
    sums = effects.effect_sums(labelled, ["node"], n, n)
    return sums.select("node", F.posexplode("v").alias("i", "total"))


@query
def holdout_naive(spark, sf):
    """Zone hold-out metrics of the two naive forecasts, per fold."""
    ds = monthly_dataset(spark, sf)
    return selection.holdout(ds, "zone", kinds=())


@query
def ablation(spark, sf):
    ds = monthly_dataset(spark, sf)
    table = selection.ablation_table(selection.holdout(ds, "zone", kinds=()))
    means = ("mae", "skill", "top4_overlap", "mae_nospike")
    return table.withColumns({c: F.round(c, 4) for c in means})


@query
def metadata_verdict(spark, sf):
    ds = monthly_dataset(spark, sf)
    forecasts = selection.holdout_forecasts(ds, kinds=("history", "metadata"))
    return selection.verdict(selection.ablation_table(selection.fold_errors(forecasts, MONTHLY_SETTINGS.top_k)))


@query
def selection_report(spark, sf):
    """Report tables of both naive forecasts as configurations, and of their zone hold-out, in one table."""
    rows = evaluate.score(naive_forecasts(weekly_samples(spark, sf)), WEEKLY_SETTINGS.top_k, "y_ref")
    errors = evaluate.metrics_by(rows, ["model_name", "split"])
    search = errors.groupBy("model_name").agg(
        F.max(F.when(F.col("split") == "val", F.col("mae"))).alias("val_mae"),
        F.max(F.when(F.col("split") == "test", F.col("mae"))).alias("test_mae"),
    )
    folds = selection.holdout(monthly_dataset(spark, sf), "zone", kinds=())
    tables = selection.report_tables(search, folds)
    ranked = tables["search"].select(
        F.lit("search").alias("section"), F.col("model_name").alias("entry"), "rank", "chosen", F.col("val_mae").alias("mae")
    )
    averaged = tables["ablation"].select(
        F.lit("ablation").alias("section"), F.col("model").alias("entry"), "rank", F.lit(None).alias("chosen"), "mae"
    )
    told = tables["holdout"].select(
        F.lit("holdout").alias("section"),
        F.concat_ws(" ", "held_out", "model").alias("entry"),
        F.lit(None).alias("rank"),
        F.lit(None).alias("chosen"),
        "mae",
    )
    kinds = "section string, entry string, rank int, chosen boolean, mae double"
    parts = [x.select(*[F.col(k.split()[0]).cast(k.split()[1]) for k in kinds.split(", ")]) for x in (ranked, averaged, told)]
    return functools.reduce(DataFrame.unionByName, parts).withColumn("mae", F.round("mae", 4))


@query
def window_search(spark, sf):
    ds = monthly_dataset(spark, sf)
    return selection.window_search(
        monthly_silver(spark, sf), ds, series.nation_catalog(spark, sf), windows=(3, 4)
    )


@query
def training_window(spark, sf):
    ds = monthly_dataset(spark, sf)
    starts = (datetime.date(1996, 1, 1), datetime.date(1998, 1, 5))
    return selection.training_window(
        monthly_silver(spark, sf), ds, series.nation_catalog(spark, sf), series.order_holidays(spark, sf), starts
    )


# --- catalogue -------------------------------------------------------------------


@query
def catalog_clean(spark, sf):
    """Customers repeated per order as raw catalogue text; the first order wins."""
    orders = table(spark, sf, "orders")
    facts = series.customer_catalog(spark, sf)
    customers = table(spark, sf, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        facts, F.col("c_name") == F.col("node")
    )
    priority = F.substring("o_orderpriority", 1, 1)
    raw = rows.select(
        F.col("o_orderkey").alias("row_order"),
        F.concat(F.lit(" "), F.col("node"), F.lit(" ")).alias("node"),
        F.col("name"),
        F.lit("SIN").alias("sistema"),
        F.when(F.col("region") == "ASIA", " No Aplica ")
        .when(F.col("region") == "EUROPE", " ")
        .otherwise(F.col("region"))
        .alias("region"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("zone")).alias("zone"),
        F.when(priority == "5", "n/d").otherwise(F.col("kv").cast("string")).alias("kv"),
        F.when(priority == "1", "X").when(priority == "2", "no").otherwise(" ").alias(
            "load_direct"
        ),
        F.when(priority == "3", "0").otherwise("1").alias("gen_direct"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("state_code"),
    )
    out = catalog.clean_catalog(raw, "20240101")
    return out.select(
        "node", "name", "region", "zone", "kv", "load_direct", "gen_direct", "gen_indirect",
        "state_code", "catalog_version",
    )


QUOTAS = {400: "all", 230: 60, 115: 30}


def selected_nodes(spark, sf) -> DataFrame:
    return catalog.select_nodes(series.customer_catalog(spark, sf), QUOTAS)


@query
def select_nodes(spark, sf):
    return selected_nodes(spark, sf).select("node", "region", "zone", "kv")


@query
def level_crosstab(spark, sf):
    return catalog.level_crosstab(selected_nodes(spark, sf))


@query
def level_pivot(spark, sf):
    wide = catalog.level_pivot(selected_nodes(spark, sf), [400.0, 230.0, 115.0])
    return wide.select(
        "region",
        F.col("`400.0`").alias("kv400"),
        F.col("`230.0`").alias("kv230"),
        F.col("`115.0`").alias("kv115"),
        "total",
    )


@query
def zone_coverage(spark, sf):
    everything = series.customer_catalog(spark, sf)
    chosen = everything.where("kv = 400 AND name = 'BUILDING'")
    out = catalog.zone_coverage(chosen, everything)
    return out.withColumn("uncovered", F.concat_ws(",", "uncovered"))


@query
def nodes_per_zone(spark, sf):
    return catalog.nodes_per_zone(selected_nodes(spark, sf))


@query
def sample_nodes(spark, sf):
    return catalog.sample_nodes(series.customer_catalog(spark, sf), 7)


@query
def node_metadata(spark, sf):
    """Line item series joined to a catalogue that knows only some of the nodes."""
    known = series.nation_catalog(spark, sf).where("region <> 'AFRICA'")
    rows = coverage.coverage_table(monthly_silver(spark, sf), MONTHLY)
    out = samples.node_metadata(rows.withColumn("sistema", F.lit("SIN")), known, MONTHLY)
    return out.select("node", "sistema", "region", "zone", "kv", "full_days")


# --- requests and bodies ---------------------------------------------------------


def nation_days(spark, sf) -> DataFrame:
    items = table(spark, sf, "lineitem")
    suppliers = table(spark, sf, "supplier")
    nations = table(spark, sf, "nation")
    sold = items.join(suppliers, items.l_suppkey == suppliers.s_suppkey).join(
        nations, suppliers.s_nationkey == nations.n_nationkey
    )
    return sold.select(
        F.col("n_name").alias("node"), F.col("l_shipdate").cast("date").alias("fecha")
    )


PLAN = (datetime.date(1996, 3, 1), datetime.date(2000, 6, 30))
PLAN_EPOCH = datetime.date(1995, 1, 3)


@query
def request_plan(spark, sf):
    """Weekly windows of nations not shipped to on every day of the window."""
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("node"))
    plan = planning.plan_requests(
        nations, "SIN", "MDA", *PLAN, have=nation_days(spark, sf), epoch=PLAN_EPOCH
    )
    keyed = planning.request_key(plan)
    return keyed.select(
        "sistema", "proceso", F.concat_ws(",", "nodes").alias("nodes"), "start", "end", "key"
    )


def order_requests(spark, sf) -> DataFrame:
    """Orders as requests: customer, segment and an order-dependent span of days."""
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer")
    day = F.col("o_orderdate").cast("date")
    span = F.substring("o_orderpriority", 1, 1).cast("int") * 2
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey",
        F.when(F.col("c_mktsegment") == "MACHINERY", "XXX").otherwise("SIN").alias("sistema"),
        F.when(F.col("o_orderstatus") == "P", "???").otherwise("MDA").alias("proceso"),
        F.array("c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey"))).alias("nodes"),
        day.alias("start"),
        F.date_add(day, span - 3).alias("end"),
    )


@query
def requested_pairs(spark, sf):
    sound = order_requests(spark, sf).where(F.col("end") >= F.col("start"))
    return planning.requested_pairs(sound)


@query
def available_pairs(spark, sf):
    sound = order_requests(spark, sf).where(F.col("end") >= F.col("start"))
    pairs = planning.requested_pairs(sound)
    covered = nation_days(spark, sf).distinct()
    return planning.available_pairs(covered, pairs)


@query
def request_validation(spark, sf):
    return planning.validate_requests(order_requests(spark, sf)).select(
        "o_orderkey", "reject_reason"
    )


def order_bodies(spark, sf) -> DataFrame:
    """Orders as service responses: their line items as hourly values.

    An order has at most seven items, so a body stays small. The spelling, the
    payload shape and the status vary with the order.
    """
    items = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    price = F.format_number("l_extendedprice", 2)
    value = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("fecha"),
        F.col("l_linenumber").cast("string").alias("hora"),
        price.alias("pml"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(
            F.col("l_quantity").cast("string")
        ).alias("pml_ene"),
    )
    bodies = items.groupBy("l_orderkey").agg(
        F.to_json(F.sort_array(F.collect_list(value))).alias("vals")
    )
    rows = orders.join(bodies, orders.o_orderkey == bodies.l_orderkey, "left")
    priority = F.substring("o_orderpriority", 1, 1)
    node = F.concat(F.lit('"C'), F.col("o_custkey").cast("string"), F.lit('"'))
    vals = F.coalesce("vals", F.lit("[]"))

    def item(node_key: str, values_key: str) -> Column:
        return F.concat(
            F.lit(f'[{{"{node_key}": '), node, F.lit(f', "{values_key}": '), vals, F.lit("}]")
        )

    def wrapped(key: str, inner: Column) -> Column:
        return F.concat(F.lit(f'{{"{key}": '), inner, F.lit("}"))

    body = (
        F.when(F.col("o_orderstatus") == "P", F.lit('{"Message": "sin datos"}'))
        .when(priority == "1", wrapped("Resultados", item("clv_nodo", "Valores")))
        .when(priority == "2", wrapped("resultados", item("nodo", "valores")))
        .when(priority == "3", item("clave", "Valores"))
        .when(priority == "4", F.lit("not json"))
        .otherwise(F.lit('{"aviso": "No se pueden mostrar datos"}'))
    )
    status = F.when(F.col("o_totalprice") < 50000, 503).when(
        F.col("o_totalprice") < 60000, 404
    ).otherwise(200)
    # parsing is the costly part, so the bodies are spread over all tasks first
    return rows.select("o_orderkey", body.alias("body"), status.alias("status_code")).repartition(
        "o_orderkey"
    )


@query
def parse_bodies(spark, sf):
    parsed = bronze.parse_bodies(order_bodies(spark, sf))
    return bronze.explode_records(parsed, ["o_orderkey"]).select(
        "o_orderkey", "node", "fecha", "hora", "pml", "pml_ene", "pml_per"
    )


@query
def body_messages(spark, sf):
    parsed = bronze.parse_bodies(order_bodies(spark, sf))
    return parsed.groupBy("message").agg(F.count("*").alias("n"))


@query
def collection_events(spark, sf):
    classified = bronze.classify(bronze.parse_bodies(order_bodies(spark, sf)))
    return bronze.collection_summary(classified)


@query
def envelope_observed(spark, sf):
    """Observed rows of all responses: last record of a body, first body of an hour."""
    envelopes = order_bodies(spark, sf).select(
        F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("path"),
        F.lit("SIN").alias("sistema"),
        F.lit("MDA").alias("proceso"),
        "body",
    )
    columns = ["node", "ts_local", "pml", "quality", "sistema", "market"]
    rows = bronze.envelope_rows(envelopes, HOURLY).select("path", *columns)
    return cleaning.first_observed(rows, HOURLY, ["path"]).select(*columns)


@query
def node_options(spark, sf):
    """Selected customers with the names and places of the catalogue."""
    facts = series.customer_catalog(spark, sf).where("name <> 'BUILDING'")
    places = facts.select(
        "node", "name", F.col("zone").alias("municipality"), F.col("region").alias("state")
    )
    return catalog.node_options(selected_nodes(spark, sf), places)


# --- daily operation -------------------------------------------------------------


def weekly_forecasts(spark, sf) -> DataFrame:
    """Stored daily forecasts: the lagged week of every sample, a tenth higher."""
    rows = weekly_samples(spark, sf)
    higher = rows.withColumn("p", F.transform("week_block", lambda v: v * 1.1))
    steps = long_steps(higher, ["node", "origin_date", "target_date"], pml_pred="p")
    return steps


@query
def daily_score(spark, sf):
    scores = daily.score_published(
        weekly_forecasts(spark, sf), weekly_silver(spark, sf), WEEKLY, settings=WEEKLY_SETTINGS
    )
    return scores.drop("scored_at")


@query
def daily_score_pending(spark, sf):
    """Scores of forecasts that were not scored before 2000."""
    forecasts = weekly_forecasts(spark, sf)
    done = forecasts.where("target_date < '2000-01-01'").select("node", "target_date")
    scores = daily.score_published(
        forecasts, weekly_silver(spark, sf), WEEKLY, done, WEEKLY_SETTINGS
    )
    return scores.select("node", "target_date", "mae", "naive24_mae")


@query
def daily_merge(spark, sf):
    """Last block's forecasts replaced by a rerun."""
    rows = weekly_samples(spark, sf)
    stored = long_steps(rows, ["node", "target_date"], pml_pred="week_block")
    rerun = long_steps(
        rows.where("target_date >= '2001-06-01'"), ["node", "target_date"], pml_pred="last_block"
    )
    return daily.replace_targets(stored, rerun)


def weekly_scores(spark, sf) -> DataFrame:
    return daily.score_published(
        weekly_forecasts(spark, sf), weekly_silver(spark, sf), WEEKLY, settings=WEEKLY_SETTINGS
    )


@query
def recent_skill(spark, sf):
    return daily.recent_skill(weekly_scores(spark, sf), 90)


@query
def latest_scored(spark, sf):
    return daily.latest_scored(weekly_scores(spark, sf))


@query
def next_targets(spark, sf):
    """One event type ends the day before, another one in the first days of the year."""
    as_of = F.lit("2024-01-30 19:00:00").cast("timestamp_ntz")
    ends = F.when(F.col("node") == "click", F.lit("2024-01-03")).when(
        F.col("node") == "view", F.lit("2024-01-29")
    )
    stored = hourly_silver(spark, sf).where(ends.isNull() | (F.col("fecha") <= ends.cast("date")))
    return daily.next_targets(stored, as_of, HOURLY, HOURLY_SETTINGS)


def weekly_requests(spark, sf) -> DataFrame:
    """Every node for every order week, up to weeks that lie past the data."""
    flags = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("node")).distinct()
    weeks = table(spark, sf, "lineitem").select(
        F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 28).alias("target_date")
    ).distinct()
    span = weeks.agg(F.sort_array(F.collect_set("target_date")).alias("w"))
    return flags.withColumn("target_date", F.explode(span.scalar()))


@query
def forecast_skips(spark, sf):
    """Why a (node, week) request gets no forecast."""
    requests = weekly_requests(spark, sf)
    stored = weekly_silver(spark, sf)
    built = daily.request_samples(requests, stored, WEEKLY, WEEKLY_SETTINGS)
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return daily.explain_requests(requests, built, stored, as_of, WEEKLY, WEEKLY_SETTINGS)


@query
def forecast_answers(spark, sf):
    """Answers for every request that has a sample: windows, audit fields, prices."""
    requests = weekly_requests(spark, sf)
    stored = weekly_silver(spark, sf)
    built = daily.request_samples(requests, stored, WEEKLY, WEEKLY_SETTINGS)
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    built = built.withColumn("y_pred", F.col("last_block"))
    answers = daily.forecast_answers(built, stored, as_of, WEEKLY)
    return answers.select(
        "node",
        "origin_date",
        "target_date",
        "issued_at",
        "history_end",
        F.col("best_window.start_hour").alias("best_start"),
        F.col("cheapest_window.start_hour").alias("cheapest_start"),
        "backtest",
        F.size("hours").alias("n_hours"),
        F.aggregate("hours", F.lit(0.0), lambda a, h: a + h["pml"]).alias("total"),
    )


@query
def pending_block(spark, sf):
    """Weekly series with an empty block after their last one."""
    stored = weekly_silver(spark, sf)
    last = stored.groupBy("node").agg(F.max("fecha").alias("origin_date"))
    return grid.with_target_blocks(stored, last, WEEKLY).groupBy("node", "quality").agg(
        F.count("*").alias("n"), F.count("pml").alias("n_prices"), F.max("ts_local").alias("last")
    )
