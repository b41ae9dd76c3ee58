"""Model selection: parameter search, hold-out folds and data-range studies."""

from __future__ import annotations

import datetime
import functools
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.config import RIDGE_ALPHAS, UNKNOWN
from loomgrid.functions import clock
from loomgrid.operators import effects, evaluate, splits
from loomgrid.operators.forecasters import (
    RidgeLags,
    collect_grams,
    gram_table,
    predict_chosen,
    predict_linear,
    price_errors,
    price_of,
    solve_ridge,
    validation_errors,
)
from loomgrid.operators.samples import build_samples
from loomgrid.plans.baselines import forecast_rows
from loomgrid.plans.dataset import Dataset, build_dataset, operation_dates
from loomgrid.session import stage

WINDOW_BLOCKS = (3, 7, 14)
# First days of the training-range study.
TRAINING_STARTS = (
    datetime.date(2016, 1, 29),
    datetime.date(2019, 1, 1),
    datetime.date(2022, 1, 1),
    datetime.date(2024, 1, 1),
)
KINDS = ("history", "metadata", "node_id")
REST = "~rest"


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """One row per combination, columns in name order."""
    rows = spark.range(1).select()
    for name in sorted(grid):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, grid[name]))))
    return rows


def _ridge_rows(ds: Dataset, metadata: bool = False) -> tuple[DataFrame, int]:
    model = RidgeLags(ds.spec, ds.settings, metadata=metadata)
    return model.design(ds.samples), model.n_inputs(ds.samples)


def _per_model(rows: DataFrame, models: dict[str, tuple]) -> DataFrame:
    """Forecast rows of several linear models over the same samples, in one pass."""
    names = F.array(*map(F.lit, models))
    predicted = predict_linear(rows, list(models.values()))
    pairs = F.explode(F.arrays_zip(names.alias("name"), F.col("z_hats").alias("z"))).alias("m")
    rows = predicted.select("*", pairs).withColumn("y_pred", price_of(F.col("m.z")))
    facts = ["sample_id", "node", "region", "zone", "split", "is_spike_day"]
    return rows.select(
        *facts,
        F.col("m.name").alias("model_name"),
        F.col("y_price").alias("y_true"),
        "y_pred",
        F.col("week_block").alias("y_ref"),
    )


def search(ds: Dataset, alphas: list[float], metadata: bool = False) -> DataFrame:
    """Rank ridge penalties by validation error, with their test metrics.

    All penalties are solved from one matrix and scored in one pass.
    """
    rows, p = _ridge_rows(ds, metadata)
    fit = rows.where(F.col("split") == "train")
    table = gram_table(fit, ["split"], p, ds.spec.steps_per_block)
    train = collect_grams(table, ["split"])[("train",)]
    models = {repr(float(a)): solve_ridge(train, p, a) for a in alphas}
    scored = evaluate.score(
        _per_model(rows.where(F.col("split") != "train"), models), ds.settings.top_k, "y_ref"
    )
    by = evaluate.metrics_by(scored, ["model_name", "split"])
    val, test = F.col("split") == "val", F.col("split") == "test"
    return (
        by.groupBy(F.col("model_name").cast("double").alias("alpha"))
        .agg(
            F.max(F.when(val, F.col("mae"))).alias("val_mae"),
            F.max(F.when(test, F.col("mae"))).alias("test_mae"),
            F.max(F.when(test, F.col("skill"))).alias("test_skill"),
            F.max(F.when(test, F.col("top4_overlap"))).alias("test_top4"),
        )
        .orderBy("val_mae", "alpha")
    )


def best(table: DataFrame, by: str = "val_mae") -> DataFrame:
    """First row of a ranking."""
    return table.orderBy(by).limit(1)


def holdout(
    ds: Dataset, regime: str, max_folds: int = 3, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """Compare model kinds and both naive forecasts on held-out nodes or zones."""
    return fold_errors(holdout_forecasts(ds, (regime,), max_folds, kinds), ds.settings.top_k)


def fold_errors(forecasts: DataFrame, top_k: int) -> DataFrame:
    """One row per (regime, held_out, model) from the forecasts of a hold-out, stored or not."""
    scored = evaluate.score(forecasts, top_k, "y_ref")
    summary = evaluate.summarize(scored, ["regime", "held_out", "model_name"])
    everything, normal = F.col("subset") == "all", F.col("subset") == "no_spike"
    return summary.groupBy("regime", "held_out", F.col("model_name").alias("model")).agg(
        F.max(F.when(everything, F.col("n_samples"))).alias("n_test"),
        F.max(F.when(everything, F.col("mae"))).alias("mae"),
        F.max(F.when(everything, F.col("skill"))).alias("skill"),
        F.max(F.when(everything, F.col("top4_overlap"))).alias("top4_overlap"),
        F.max(F.when(normal, F.col("mae"))).alias("mae_nospike"),
    )


FORECAST_FACTS = ("sample_id", "node", "region", "zone", "split", "is_spike_day")


def holdout_forecasts(
    ds: Dataset,
    regimes: tuple[str, ...] = ("node", "zone"),
    max_folds: int = 3,
    kinds: tuple[str, ...] = KINDS,
) -> DataFrame:
    """Test forecasts of held-out nodes and zones by models that never saw them.

    One pass sums the samples per split and held-out labels, one their sums per node; the
    matrix of a fold is the total minus the held-out part, for every kind and regime.
    ``history`` reads lagged prices, calendar and level, ``metadata`` also the catalogue and an
    effect per zone, ``node_id`` also one per node. What a fold holds out has no effect there, as
    has the zone UNKNOWN anywhere. Folds without test or train samples are skipped.
    """
    folds: list[tuple[str, str]] = []
    for regime in regimes:
        if regime not in ("node", "zone"):
            raise ValueError("regime must be 'node' or 'zone'")
        found = (splits.node_folds if regime == "node" else splits.zone_folds)(ds.index, max_folds)
        # at most max_folds labels
        folds += [(regime, r["held_out"]) for r in found.select("held_out", "fold").orderBy("fold").collect()]
    parts = _ridge_folds(ds, folds, kinds) if kinds and folds else []
    inside = _in_folds(ds.positions("test"), folds, range(len(folds)))
    for name, column in (("naive168", "week_block"), ("naive24", "last_block")):
        parts.append(_fold_rows(inside, folds, F.lit(name), F.col(column)))
    return functools.reduce(DataFrame.unionByName, parts)


def _in_folds(rows: DataFrame, folds: list[tuple[str, str]], usable) -> DataFrame:
    """Each sample once per fold that holds it out, with the fold's number."""
    numbers = [F.when(F.col(folds[i][0]) == folds[i][1], F.lit(i)) for i in usable]
    found = F.array(*numbers) if numbers else F.array().cast("array<int>")
    return rows.withColumn("fold", F.explode(F.array_compact(found)))


def _fold_rows(rows: DataFrame, folds: list[tuple[str, str]], name: Column, forecast: Column) -> DataFrame:
    def fact(part: int) -> Column:
        labels = F.array(*[F.lit(f[part]) for f in folds]) if folds else F.array().cast("array<string>")
        return F.get(labels, F.col("fold"))

    return rows.select(
        *FORECAST_FACTS,
        fact(0).alias("regime"),
        fact(1).alias("held_out"),
        name.alias("model_name"),
        F.col("y_price").alias("y_true"),
        forecast.alias("y_pred"),
        F.col("week_block").alias("y_ref"),
    )


def _ridge_folds(ds: Dataset, folds: list[tuple[str, str]], kinds: tuple[str, ...]) -> list[DataFrame]:
    model = RidgeLags(ds.spec, ds.settings, metadata=True)
    p, q = model.n_inputs(ds.samples), ds.spec.steps_per_block
    own = p - model.n_meta(ds.samples)
    held = {}
    for regime in dict(folds):
        labels = [label for r, label in folds if r == regime]
        held[regime] = F.when(F.col(regime).isin(labels), F.col(regime)).otherwise(F.lit(REST))
    strata = ["split", *[f"held_{r}" for r in held]]
    rows = model.design(ds.samples).withColumns({f"held_{r}": c for r, c in held.items()})
    rows = stage(rows.select(*FORECAST_FACTS, *strata[1:], "x", "t", "mu", "sigma", "y_price", "week_block"), "design")
    fit = rows.where(F.col("split").isin("train", "val"))
    grams = collect_grams(gram_table(fit, strata, p, q), strata)

    def total(fold: int, *periods: str):
        regime, label = folds[fold]
        place = strata.index(f"held_{regime}")
        kept = [g for key, g in grams.items() if key[0] in periods and key[place] != label]
        return sum(kept) if kept else None

    usable = [i for i in range(len(folds)) if total(i, "train") is not None]
    if not usable:
        return []
    # the fits on train choose the penalty, those on both periods forecast
    periods = (("train",), ("train", "val"))
    fits = [(i, period, alpha) for period in periods for i in usable for alpha in RIDGE_ALPHAS]
    matrices = [total(i, *period) for i, period, _ in fits]
    models = [(kind, number) for number in range(len(fits)) for kind in kinds]
    weights, maps = _with_effects(fit, folds, fits, matrices, models, own, p, q)
    rows = rows.join(maps[0], "zone", "left").join(maps[1], ["zone", "node"], "left")
    effect_maps = (F.col("zone_effects"), F.col("node_effects"))

    tried = len(models) // len(periods)
    z_hats = effects.add_effects(F.col("z_hats"), *effect_maps)
    scored = (
        predict_linear(rows.where(F.col("split") == "val"), weights[:tried])
        .withColumn("z_hats", z_hats)
        .select("node", "zone", price_errors("z_hats").alias("errors"))
    )
    seen = [F.col(folds[i][0]) != folds[i][1] for i, _, _ in fits]
    means = [F.avg(F.when(seen[fit_no], F.get("errors", F.lit(m)))) for m, (_, fit_no) in enumerate(models[:tried])]
    errors = scored.agg(*means).first()
    chosen: dict[int, list[int]] = {}
    for i in usable:
        for kind in kinds:
            candidates = [m for m in range(tried) if models[m][0] == kind and fits[models[m][1]][0] == i]
            best_one = candidates[len(candidates) // 2]
            if total(i, "val") is not None:
                best_one = min(candidates, key=lambda m: float("inf") if errors[m] is None else errors[m])
            # the same fold and penalty on both periods
            chosen.setdefault(i, []).append(best_one + tried)

    inside = _in_folds(rows.where(F.col("split") == "test"), folds, usable)
    numbers = F.array(
        *[F.array(*[F.lit(m) for m in chosen.get(i, [])]).cast("array<int>") for i in range(len(folds))]
    )
    told = predict_chosen(inside, "fold", {i: [weights[m] for m in chosen[i]] for i in usable})
    pairs = F.arrays_zip(
        F.array(*map(F.lit, kinds)).alias("kind"), F.get(numbers, F.col("fold")).alias("m"), F.col("z_hats").alias("z")
    )
    told = told.select("*", F.explode(pairs).alias("k"))
    for effect_of in effect_maps:
        found = F.try_element_at(effect_of, F.col("k.m"))
        moved = F.when(found.isNull(), F.col("k.z")).otherwise(F.zip_with("k.z", found, lambda a, b: a + b))
        told = told.withColumn("k", F.struct(F.col("k.kind"), F.col("k.m"), moved.alias("z")))
    return [_fold_rows(told, folds, F.col("k.kind"), price_of(F.col("k.z")))]


def _with_effects(
    fit: DataFrame,
    folds: list[tuple[str, str]],
    fits: list[tuple],
    matrices: list,
    models: list[tuple[str, int]],
    own: int,
    p: int,
    q: int,
) -> tuple[list[tuple], tuple[DataFrame, DataFrame]]:
    """Weights of every model, and the tables of zone and node effects by model number."""
    sums = effects.effect_sums(fit, ["split", "zone", "node"], p, q)
    members = [
        F.when(
            F.col("split").isin(list(period)) & (F.col(folds[i][0]) != folds[i][1]),
            F.struct(F.lit(number).alias("fit"), F.lit(float(alpha)).alias("alpha")),
        )
        for number, (i, period, alpha) in enumerate(fits)
    ]
    size = 1 + p + q
    per_fit = stage(sums, "sums").select(
        "zone", "node", "v", F.explode(F.array_compact(F.array(*members))).alias("f")
    )
    per_fit = effects.total_sums(per_fit.select("f.*", F.col("zone").alias("grp"), F.col("node").alias("entity"), "v"), size)
    zones, nodes, behind = effects.levels(stage(per_fit, "fits"), size, F.col("grp") != UNKNOWN)
    as_kind = lambda df, kind: df.select(F.lit(kind).alias("kind"), "fit", "alpha", "v")
    terms = as_kind(zones, "metadata").unionByName(as_kind(nodes, "node_id")).unionByName(as_kind(behind, "node_id"))
    taken = collect_grams(effects.eliminated(terms, size), ["kind", "fit"])
    few = [*range(1 + own), *range(1 + p, size)]
    weights = []
    for kind, number in models:
        gram, alpha = matrices[number], fits[number][2]
        if kind == "history":
            coef, intercept = solve_ridge(gram[np.ix_(few, few)], own, alpha)
            coef = np.vstack([coef, np.zeros((p - own, q))])
        else:
            coef, intercept = effects.solve_reduced(gram, taken.get((kind, number), 0.0), p, alpha)
        weights.append((coef, intercept))

    def of(kind: str) -> dict[int, tuple]:
        return {number: weights[m] for m, (k, number) in enumerate(models) if k == kind}

    def numbered(rows: DataFrame, kind: str) -> DataFrame:
        place = {number: m for m, (k, number) in enumerate(models) if k == kind}
        return rows.withColumn("model", F.get(F.array(*[F.lit(place.get(n)).cast("int") for n in range(len(fits))]), F.col("fit")))

    by_zone = effects.effects(zones, of("metadata"), q) if of("metadata") else zones.where("false").withColumn("effect", F.col("v"))
    outer = effects.effects(behind, of("node_id"), q) if of("node_id") else behind.where("false").withColumn("effect", F.col("v"))
    inner = nodes.join(outer.select("fit", "grp", F.col("effect").alias("outer")), ["fit", "grp"], "left")
    inner = inner.withColumn("outer", F.coalesce("outer", F.array_repeat(F.lit(0.0), q)))
    by_node = effects.effects(inner, of("node_id"), q) if of("node_id") else inner.where("false").withColumn("effect", F.col("v"))
    zone_rows = numbered(by_zone, "metadata").select("grp", "model", "effect").unionByName(
        numbered(outer, "node_id").select("grp", "model", "effect")
    )
    node_rows = numbered(by_node, "node_id")
    zone_map = effects.by_label(zone_rows, ["grp"], "zone_effects").withColumnRenamed("grp", "zone")
    node_map = effects.by_label(node_rows, ["grp", "entity"], "node_effects")
    node_map = node_map.withColumnsRenamed({"grp": "zone", "entity": "node"})
    return weights, (stage(zone_map, "zone-effects"), stage(node_map, "node-effects"))


def ablation_table(folds: DataFrame) -> DataFrame:
    """Average the folds per regime and model."""
    means = ("mae", "skill", "top4_overlap", "mae_nospike")
    return (
        folds.groupBy("regime", "model")
        .agg(
            F.countDistinct("held_out").alias("folds"),
            F.sum("n_test").alias("n_test"),
            *[F.avg(c).alias(c) for c in means],
        )
        .orderBy("regime", "mae")
    )


def verdict(ablation: DataFrame) -> DataFrame:
    """Whether metadata inputs win in every regime that compares both kinds."""
    wide = ablation.groupBy("regime").pivot("model", ["metadata", "history"]).agg(F.max("mae"))
    both = wide.where(F.col("metadata").isNotNull() & F.col("history").isNotNull())
    return both.agg(
        F.count("*").alias("regimes"),
        F.coalesce(F.bool_and(F.col("metadata") <= F.col("history")), F.lit(True)).alias("ships"),
    )


def ranking(table: DataFrame, by: str = "val_mae") -> DataFrame:
    """The configurations of a study (one row each) with their ``rank`` and which one is ``chosen``.

    Configurations of the same error are ranked by their own columns, unknown errors last.
    """
    own = [c for c in table.columns if not c.startswith(("val_", "test_"))]
    order = Window.orderBy(F.col(by).asc_nulls_last(), *own)
    ranked = table.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("chosen", (F.col("rank") == 1) & F.col(by).isNotNull())


def report_tables(
    search: DataFrame | None = None,
    folds: DataFrame | None = None,
    windows: DataFrame | None = None,
    training: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables of a selection report by name, of the studies that were made.

    ``search``, ``windows`` and ``training`` are ranked by validation error; of the hold-out ``folds``
    come their averages, each model's rank within its regime, and the verdict on metadata.
    """
    studies = {"search": search, "windows": windows, "training": training}
    tables = {name: ranking(table) for name, table in studies.items() if table is not None}
    if folds is not None:
        # folds are models that were fitted: written, since two tables read them
        folds = stage(folds, "folds")
        order = Window.partitionBy("regime").orderBy(F.col("mae").asc_nulls_last(), "model")
        tables["holdout"] = folds
        tables["ablation"] = ablation_table(folds).withColumn("rank", F.row_number().over(order))
        tables["verdict"] = verdict(tables["ablation"])
    return tables


def _evaluate_ridge(ds: Dataset) -> tuple[float, DataFrame]:
    model = RidgeLags(ds.spec, ds.settings).fit(ds.samples)
    rows = model.design(ds.samples)
    val = validation_errors(
        rows.where(F.col("split") == "val"), [(model.coef, model.intercept)]
    )[0] / ds.spec.steps_per_block
    predicted = forecast_rows(model.predict(ds.positions("test")), model.name)
    scored = evaluate.score(predicted, ds.settings.top_k, "y_ref")
    return val, evaluate.metrics_by(scored, ["model_name"])


def _study_row(ds: Dataset, leading: list) -> DataFrame:
    val, test = _evaluate_ridge(ds)
    return test.select(
        *leading,
        F.lit(float(val)).alias("val_mae"),
        F.col("mae").alias("test_mae"),
        F.col("skill").alias("test_skill"),
        F.col("top4_overlap").alias("test_top4"),
    )


def window_search(
    silver: DataFrame, ds: Dataset, catalog=None, holidays=None, windows=WINDOW_BLOCKS
) -> DataFrame:
    """Compare input lengths; each length builds its own samples from the same rows."""
    out = None
    for blocks in windows:
        settings = replace(ds.settings, input_blocks=blocks)
        variant = build_dataset(
            silver,
            catalog,
            f"w{blocks}",
            ds.spec,
            settings,
            holidays=holidays,
            sequences=False,
        )
        row = _study_row(
            variant,
            [
                F.lit(blocks).alias("input_days"),
                F.lit(blocks * ds.spec.steps_per_block).alias("input_hours"),
                F.lit(variant.samples.count()).alias("n_samples"),
            ],
        )
        out = row if out is None else out.unionByName(row)
    return out.orderBy("val_mae")


def training_window(
    silver: DataFrame, ds: Dataset, catalog=None, holidays=None, starts=TRAINING_STARTS
) -> DataFrame:
    """Compare how far back the training data reaches, with the same end.

    Starts before the first origin of the dataset are skipped, as are those behind its last
    target. Input length and split settings are those of the dataset; ``holidays`` and
    ``catalog`` have to be its own. No start builds a dataset: samples whose windows lie
    behind a start are those of the dataset, summed once per stretch between two starts, so that a
    start takes the stretches behind it. Only the few blocks whose windows a start cuts are built.
    """
    first, last = ds.samples.agg(F.min("origin_date"), F.max("target_date")).first()
    kept = [s for s in sorted(set(starts)) if first is not None and first <= s <= last]
    if not kept:
        raise ValueError("every start lies outside the data")
    rows = _from_starts(silver, ds, catalog, holidays, kept)
    model = RidgeLags(ds.spec, ds.settings)
    p, q = model.n_inputs(ds.samples), ds.spec.steps_per_block
    fit = rows.where(F.col("split").isin("train", "val"))
    grams = collect_grams(gram_table(fit, ["split", "stretch"], p, q), ["split", "stretch"])
    facts = {(r["split"], r["stretch"]): r["n"] for r in rows.groupBy("split", "stretch").agg(F.count("*").alias("n")).collect()}
    behind = [[f"from-{i:04d}" for i in range(k, len(kept))] + [f"head-{k:04d}"] for k in range(len(kept))]

    def total(k: int, *periods: str):
        found = [g for (split, stretch), g in grams.items() if split in periods and stretch in behind[k]]
        return sum(found) if found else None

    tried = [(k, alpha) for k in range(len(kept)) for alpha in RIDGE_ALPHAS]
    for k, start in enumerate(kept):
        if total(k, "train") is None:
            raise ValueError(f"no training samples from {start} on")
    models = [solve_ridge(total(k, *period), p, a) for period in (("train",), ("train", "val")) for k, a in tried]
    scored = predict_linear(rows.where(F.col("split") == "val"), models).select(
        "stretch", price_errors("z_hats").alias("errors")
    )
    inside = [F.col("stretch").isin(names) for names in behind]
    means = [
        F.avg(F.when(inside[tried[m % len(tried)][0]], F.get("errors", F.lit(m)))) for m in range(len(models))
    ]
    errors = [float("inf") if e is None else e for e in scored.agg(*means).first()]
    chosen = []
    for k in range(len(kept)):
        own = [m for m, (j, _) in enumerate(tried) if j == k]
        best_one = min(own, key=lambda m: errors[m]) if total(k, "val") is not None else own[len(own) // 2]
        chosen.append(best_one + len(tried))
    member = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(inside)]))
    test = rows.where(F.col("split") == "test").withColumn("variant", F.explode(member))
    told = predict_chosen(test, "variant", {k: [models[m]] for k, m in enumerate(chosen)})
    told = told.withColumn("y_pred", price_of(F.col("z_hats")[0]))
    forecasts = told.select(
        F.col("variant").cast("string").alias("model_name"),
        "is_spike_day",
        F.col("y_price").alias("y_true"),
        "y_pred",
        F.col("week_block").alias("y_ref"),
    )
    errors_of = evaluate.metrics_by(evaluate.score(forecasts, ds.settings.top_k, "y_ref"), ["model_name"])

    def count(k: int, split: str | None = None) -> int:
        return sum(n for (s, stretch), n in facts.items() if stretch in behind[k] and split in (None, s))

    lead = [
        (str(k), start.isoformat(), round((last - start).days / 365.25, 1), count(k, "train"), errors[chosen[k]] / q)
        for k, start in enumerate(kept)
    ]
    # one row per start
    known = rows.sparkSession.createDataFrame(
        lead, "model_name string, start string, train_years double, n_train int, val_mae double"
    )
    return (
        known.join(errors_of, "model_name", "left")
        .select(
            "start",
            "train_years",
            "n_train",
            "val_mae",
            F.col("mae").alias("test_mae"),
            F.col("skill").alias("test_skill"),
            F.col("top4_overlap").alias("test_top4"),
        )
        .orderBy("val_mae")
    )


def _from_starts(silver: DataFrame, ds: Dataset, catalog, holidays, starts: list) -> DataFrame:
    """Design rows by ``stretch``: ``from-k`` lies behind the windows that start k cuts and before those of
    the next one, ``head-k`` holds the samples of the blocks in whose windows start k cuts."""
    spec, settings = ds.spec, ds.settings
    reach = max(settings.stats_blocks, settings.input_blocks, settings.week_lag)
    # the first block behind a start whose windows hold none of the blocks that the start cuts
    whole = [clock.block_of_date(F.lit(s), spec) + reach for s in starts]
    stretch = F.lit(None).cast("string")
    for k, block in enumerate(whole):
        stretch = F.when(F.col("block") >= block, f"from-{k:04d}").otherwise(stretch)
    design = RidgeLags(spec, settings).design
    facts = ["is_spike_day", "target_date", "mu", "sigma", "y_price", "week_block"]
    end = ds.samples.agg(F.max("target_date").alias("d")).scalar()
    rows = design(ds.samples).withColumn("stretch", stretch).where(F.col("stretch").isNotNull())
    rows = rows.select(*facts, "x", "t", "stretch")
    nodes = ds.samples.select(*spec.keys).distinct()
    for k, start in enumerate(starts):
        near = operation_dates(silver, start).join(nodes, list(spec.keys), "left_semi")
        # as far as the target of the last such block, and no further than the dataset
        near = near.where(clock.block_of_date(F.col("fecha"), spec) <= whole[k])
        near = near.where(F.col("fecha") < F.date_add(end, spec.block_days))
        head = build_samples(near, spec, settings, catalog, holidays, only=F.col("block") < whole[k], sequences=False)
        head = design(head).withColumn("stretch", F.lit(f"head-{k:04d}"))
        rows = rows.unionByName(head.select(*facts, "x", "t", "stretch"))
    return stage(splits.assign_splits(rows, settings, ds.index), "starts")
