import datetime
import math

import numpy as np
import pytest
from conftest import HOURLY, silver_from_days
from pyspark.sql import functions as F

from loomgrid.config import Settings
from loomgrid.operators import forecasters
from loomgrid.operators.forecasters import BatchScorer, RidgeLags, SeasonalMA
from loomgrid.plans import baselines, dataset, selection
from loomgrid.sources import gold

SETTINGS = Settings(test_months=1, val_days=14)


@pytest.fixture(scope="module")
def ds(three_series, three_nodes):
    return dataset.build_dataset(three_series, three_nodes, "small", HOURLY, SETTINGS)


def test_naive_forecasts_read_the_right_days(ds, three_series):
    s = ds.samples.where("node = 'DAM-1'").orderBy("origin_date").first()
    day = lambda d: [
        r["pml"] for r in three_series.where("node = 'DAM-1'").where(
            F.col("fecha") == F.lit(d)).orderBy("hora").collect()]
    assert s["last_block"] == day(s["origin_date"])
    assert s["week_block"] == day(s["origin_date"] - datetime.timedelta(days=6))
    assert s["week_block"] == day(s["target_date"] - datetime.timedelta(days=7))


def test_week_block_is_there_for_short_windows(three_series):
    short = Settings(input_blocks=3)
    row = dataset.build_dataset(
        three_series, None, "short", HOURLY, short, nodes=["KITE-2"], staged=False
    ).samples.orderBy("origin_date").first()
    assert len(row["week_block"]) == 24 and len(row["X_seq"]) == 72


def test_seasonal_average_recovers_a_sinusoid(spark):
    start = datetime.date(2020, 1, 1)
    days = [start + datetime.timedelta(days=i) for i in range(730)]
    level = lambda d: 1000 + 200 * math.sin(2 * math.pi * d.timetuple().tm_yday / 365)
    silver = silver_from_days(spark, [["ok"] * 24] * 730, [[level(d)] * 24 for d in days], start=start)
    cutoff = spark.sql("SELECT date'2021-12-31' AS d")
    model = SeasonalMA(HOURLY).fit_until(silver, cutoff)
    targets = spark.createDataFrame(
        [("N1", datetime.date(2022, m, 11)) for m in range(1, 13)], "node string, target_date date"
    )
    for r in model.predict(targets).collect():
        assert len(r["y_pred"]) == 24
        assert r["y_pred"][3] == pytest.approx(level(r["target_date"]), rel=0.03)
        assert max(r["y_pred"]) - min(r["y_pred"]) < 1e-6


def test_seasonal_average_needs_full_days_and_guards_small_levels(spark):
    prices = [[2.0] * 24, [100.0 * (h < 12) for h in range(24)], [None] + [50.0] * 23]
    silver = silver_from_days(spark, [["ok"] * 24] * 3, prices)
    model = SeasonalMA(HOURLY).fit_until(silver, spark.sql("SELECT date'2024-02-01' AS d"))
    shapes = {r["dow"]: r["shape"] for r in model.shapes.collect()}
    assert list(shapes) == [1] and shapes[1][0] == pytest.approx(2.0) and shapes[1][20] == 0.0
    assert model.means.first()["overall"] == pytest.approx((2.0 + 50.0) / 2)
    far = spark.createDataFrame([("N1", datetime.date(2024, 7, 1))], "node string, target_date date")
    assert model.predict(far).first()["y_pred"] == pytest.approx([26.0] * 24)


def closed_form(x, y, alpha):
    xm, ym = x.mean(axis=0), y.mean(axis=0)
    coef = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return coef, ym - xm @ coef


def test_ridge_equals_the_closed_form(ds):
    model = RidgeLags(HOURLY, SETTINGS).fit(ds.samples)
    rows = model.design(ds.samples).select("split", "x", "t", "mu", "sigma", "y_price").collect()
    data = {s: (np.array([r["x"] for r in rows if r["split"] == s]),
                np.array([r["t"] for r in rows if r["split"] == s])) for s in ("train", "val")}
    assert data["train"][0].shape[1] == 92
    val = [r for r in rows if r["split"] == "val"]
    errors = []
    for alpha in model.alphas:
        coef, b = closed_form(*data["train"], alpha)
        z = data["val"][0] @ coef + b
        p = np.array([r["mu"] for r in val])[:, None] + np.array([r["sigma"] for r in val])[:, None] * z
        errors.append(np.abs(p - np.array([r["y_price"] for r in val])).mean())
    assert model.alpha == model.alphas[int(np.argmin(errors))]
    x, y = (np.vstack([data["train"][i], data["val"][i]]) for i in (0, 1))
    coef, b = closed_form(x, y, model.alpha)
    np.testing.assert_allclose(model.coef, coef, atol=1e-8)
    np.testing.assert_allclose(model.intercept, b, atol=1e-8)
    test = model.predict(ds.positions("test")).select("sample_id", "y_pred").orderBy("sample_id")
    again = model.predict(ds.positions("test")).select("sample_id", "y_pred").orderBy("sample_id")
    assert test.collect() == again.collect()


def test_ridge_without_validation_uses_the_middle_penalty(ds):
    model = RidgeLags(HOURLY, SETTINGS).fit(ds.samples.where("split <> 'val'"))
    assert model.alpha == 1.0
    with pytest.raises(ValueError):
        RidgeLags(HOURLY, SETTINGS).fit(ds.samples.where("split = 'test'"))


def test_design_width_follows_the_window(ds):
    assert RidgeLags(HOURLY, Settings(input_blocks=14)).n_inputs(ds.samples) == 99


def test_supplied_model_is_loaded_and_inverted(ds):
    scorer = BatchScorer(lambda: (lambda seq, cal, level: np.zeros((len(seq), 24))), "zero")
    row = scorer.predict(ds.positions("test")).first()
    assert row["y_pred"] == pytest.approx([row["mu"]] * 24)


def test_run_all_and_stored_predictions(spark, ds, three_series, tmp_path):
    forecasts = baselines.run_all(ds, three_series)
    n = ds.positions("test").count()
    table = {r["model_name"]: r for r in baselines.summary_table(baselines.summaries(forecasts)).collect()}
    assert set(table) == set(forecasters.BASELINES)
    assert table["naive168"]["skill"] == pytest.approx(0.0)
    assert table["linear_lags"]["mae"] < table["naive24"]["mae"]
    long = baselines.predictions_table(forecasts)
    path = str(tmp_path / "predictions")
    gold.write_predictions(long, path)
    gold.write_predictions(long.where("model_name = 'naive24'"), path)
    back = gold.read_predictions(spark, path)
    assert back.count() == 4 * n * 24
    one = gold.read_predictions(spark, path, ["naive24", "absent"], ["KITE-2"])
    assert {r[0] for r in one.select("model_name").distinct().collect()} == {"naive24"}
    report = baselines.evaluation_report(ds, forecasts, list(forecasters.BASELINES))
    assert report.headline.first()["n_samples"] == n
    assert report.by_subset.count() == 12 and report.by_hour.count() == 4 * 24
    with pytest.raises(ValueError):
        baselines.evaluation_report(ds, forecasts, ["naive24"])


def test_fold_matrices_equal_a_direct_fit(ds):
    rows, p = selection._ridge_rows(ds)
    rows = rows.withColumn("held", F.when(F.col("zone") == "NORTHSHORE", "NORTHSHORE").otherwise("~rest"))
    strata = ["split", "held"]
    fit = rows.where("split <> 'test'")
    grams = forecasters.collect_grams(forecasters.gram_table(fit, strata, p, 24), strata)
    direct = forecasters.collect_grams(
        forecasters.gram_table(fit.where("zone <> 'NORTHSHORE'"), ["split"], p, 24), ["split"])
    kept = sum(g for (s, h), g in grams.items() if s == "train" and h != "NORTHSHORE")
    np.testing.assert_allclose(kept, direct[("train",)], rtol=1e-9, atol=1e-9)


def test_holdout_ablation_and_verdict(spark, ds):
    folds = selection.holdout(ds, "zone")
    rows = folds.collect()
    assert {r["model"] for r in rows} == {"history", "metadata", "node_id", "naive24", "naive168"}
    assert {r["held_out"] for r in rows} == {"NORTHSHORE", "BAYSIDE"}
    assert all(r["skill"] == pytest.approx(0.0) for r in rows if r["model"] == "naive168")
    verdict = selection.verdict(selection.ablation_table(folds)).first()
    assert verdict["regimes"] == 1
    hand = spark.createDataFrame(
        [("node", "A", "history", 10, 800.0, 0.1, 0.5, 700.0),
         ("node", "B", "history", 10, 900.0, 0.3, 0.7, 800.0)],
        "regime string, held_out string, model string, n_test long, mae double, skill double,"
        " top4_overlap double, mae_nospike double",
    )
    row = selection.ablation_table(hand).first()
    assert (row["folds"], row["n_test"], row["mae"]) == (2, 20, 850.0)
    with pytest.raises(ValueError):
        selection.holdout(ds, "other")


def test_parameter_grid_and_search(spark, ds):
    grid = selection.parameter_grid(spark, {"b": [1, 2], "a": ["x", "y", "z"]})
    assert grid.columns == ["a", "b"] and grid.count() == 6
    table = selection.search(ds, [0.1, 10.0])
    rows = table.collect()
    assert rows[0]["val_mae"] <= rows[1]["val_mae"]
    assert selection.best(table).first()["alpha"] == rows[0]["alpha"]
