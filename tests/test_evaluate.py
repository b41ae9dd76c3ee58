import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import evaluate

TRUE = [100.0, 200.0, 300.0] + [0.0] * 21
PRED = [110.0, 180.0, 300.0] + [0.0] * 21


def scored(spark, rows, **kw):
    frame = spark.createDataFrame(
        [(i, t, p, False) for i, (t, p) in enumerate(rows)],
        "id int, y_true array<double>, y_pred array<double>, is_spike_day boolean",
    )
    return evaluate.score(frame, **kw)


def hours(*picked, high=1000.0):
    out = [float(i) for i in range(24)]
    for h in picked:
        out[h] = high + h
    return out


def test_error_metrics(spark):
    m = evaluate.metrics_by(scored(spark, [(TRUE, PRED)]), []).first()
    assert m["mae"] == pytest.approx(30 / 24)
    assert m["rmse"] == pytest.approx(math.sqrt(500 / 24))
    assert m["smape"] == pytest.approx(100 * (20 / 210 + 40 / 380) / 24)
    assert m["skill"] is None and m["n_samples"] == 1


@pytest.mark.parametrize(
    "a,b,want", [((17, 19, 20, 21), (18, 19, 20, 21), 0.75), ((1, 2, 3, 4), (1, 2, 3, 4), 1.0),
                 ((1, 2, 3, 4), (5, 6, 7, 8), 0.0)])
def test_overlap(spark, a, b, want):
    row = scored(spark, [(hours(*a), hours(*b))]).first()
    assert row["overlap"] == want


def test_ties_go_to_the_earlier_hour(spark):
    row = spark.createDataFrame([([5.0] * 24,)], "v array<double>").select(
        evaluate.top_positions(F.col("v"), 4).alias("p")).first()
    assert row["p"] == [0, 1, 2, 3]


def test_captured_value(spark):
    actual = [0.0] * 20 + [100.0, 200.0, 200.0, 300.0]
    guess = [0.0] * 19 + [9.0, 0.0, 9.0, 9.0, 9.0]
    zero = [0.0] * 24
    rows = scored(spark, [(actual, guess), (zero, zero)])
    values = {r["id"]: r["captured"] for r in rows.collect()}
    assert values[0] == pytest.approx(700 / 800) and values[1] is None
    assert evaluate.metrics_by(rows, []).first()["captured_value"] == pytest.approx(700 / 800)


def test_random_samples_match_numpy(spark):
    rng = np.random.default_rng(3)
    t, p, r = (np.round(rng.normal(50, 30, (40, 24)), 0) for _ in range(3))
    frame = spark.createDataFrame(
        [(a.tolist(), b.tolist(), c.tolist(), bool(i % 3 == 0)) for i, (a, b, c) in enumerate(zip(t, p, r))],
        "y_true array<double>, y_pred array<double>, ref array<double>, is_spike_day boolean")
    out = {x["subset"]: x for x in evaluate.summarize(evaluate.score(frame, 4, "ref"), []).collect()}
    spike = np.arange(40) % 3 == 0
    for name, mask in (("all", spike | True), ("no_spike", ~spike), ("spike", spike)):
        a, b, c = t[mask], p[mask], r[mask]
        assert out[name]["mae"] == pytest.approx(np.abs(a - b).mean())
        assert out[name]["skill"] == pytest.approx(1 - np.abs(a - b).mean() / np.abs(a - c).mean())
        ta = np.argsort(-a, axis=1, kind="stable")[:, :4]
        tb = np.argsort(-b, axis=1, kind="stable")[:, :4]
        shared = [len(set(x) & set(y)) / 4 for x, y in zip(ta, tb)]
        assert out[name]["top4_overlap"] == pytest.approx(np.mean(shared))
        got, best = np.take_along_axis(a, tb, 1).sum(1), np.take_along_axis(a, ta, 1).sum(1)
        assert out[name]["captured_value"] == pytest.approx((got / best).mean())
        assert out[name]["n_samples"] == mask.sum()


def test_empty_subset_keeps_its_row(spark):
    rows = evaluate.summarize(scored(spark, [(TRUE, PRED)]), []).collect()
    spike = next(r for r in rows if r["subset"] == "spike")
    assert spike["n_samples"] == 0 and spike["mae"] is None
    flat = evaluate.flat_metrics(evaluate.summarize(scored(spark, [(TRUE, PRED)]), []), [])
    names = {r["metric"]: r["value"] for r in flat.collect()}
    assert names["test_mae"] == pytest.approx(30 / 24) and names["n_test_spike"] == 0.0
    assert "test_skill" not in names and "test_mae_spike" not in names


def test_block_window(spark):
    prices = [100.0] * 24
    prices[2] = 5000.0
    for h in (10, 11, 12, 13):
        prices[h] = 1500.0
    row = spark.createDataFrame([(prices,)], "p array<double>").select(
        evaluate.block_window(F.col("p"), 4).alias("w"),
        evaluate.block_window(F.col("p"), 4, False).alias("c")).first()
    assert (row["w"]["start_hour"], row["w"]["end_hour"]) == (11, 14)
    assert (row["c"]["start_hour"], row["c"]["end_hour"]) == (4, 7)


def test_shape_and_parity_checks(spark):
    good = scored(spark, [(TRUE, PRED), (TRUE, PRED[:5])])
    assert evaluate.shape_errors(good, 24).count() == 1
    rows = [(1, h, float(h)) for h in range(1, 25)]
    a = spark.createDataFrame(rows, "sample_id int, hora int, pml_pred double")
    b = a.withColumn("pml_pred", F.col("pml_pred") + F.when(F.col("hora") == 3, 0.5).otherwise(0.0))
    out = evaluate.parity(a, b, 0.1).first()
    assert (out["n_rows"], out["max_abs_diff"], out["within"]) == (24, 0.5, False)


def test_long_predictions_fold_back(spark):
    rows = [(7, h, float(h), float(25 - h)) for h in range(24, 0, -1)]
    long = spark.createDataFrame(rows, "sample_id int, hora int, pml_actual double, pml_pred double")
    row = evaluate.from_long(long, ["sample_id"]).first()
    assert row["y_true"] == [float(h) for h in range(1, 25)] and row["y_pred"][0] == 24.0
