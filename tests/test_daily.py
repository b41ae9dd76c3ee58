import datetime

import pytest
from conftest import HOURLY, hourly_rows, price_days
from pyspark.sql import functions as F

from loomgrid.config import Settings
from loomgrid.operators import coverage, grid, planning, samples
from loomgrid.plans import daily
from loomgrid.sources import gold

D = datetime.date
EPOCH = D(2016, 1, 29)


def plan(spark, nodes, start, end, have=None):
    frame = spark.createDataFrame([(n,) for n in nodes], "node string")
    rows = planning.plan_requests(frame, "SIN", "MDA", start, end, have).orderBy("start", "nodes")
    return rows.collect()


def test_windows_are_anchored_and_clipped(spark):
    rows = planning.epoch_windows(spark, "MDA", D(2016, 2, 10), D(2016, 2, 28)).orderBy("window").collect()
    assert (rows[0]["window_start"], rows[0]["window_end"]) == (D(2016, 2, 5), D(2016, 2, 11))
    assert (rows[-1]["window_start"], rows[-1]["window_end"]) == (D(2016, 2, 26), D(2016, 2, 28))
    assert planning.epoch_windows(spark, "MDA", D(2015, 1, 1), D(2015, 2, 1)).count() == 0
    assert planning.epoch_windows(spark, "MDA", D(2015, 1, 1), EPOCH).count() == 1


def test_batches_and_coverage(spark):
    start, end = EPOCH, EPOCH + datetime.timedelta(days=6)
    nodes = [f"N{i:02d}" for i in range(45)]
    assert [len(r["nodes"]) for r in plan(spark, nodes, start, end)] == [20, 20, 5]
    days = [start + datetime.timedelta(days=i) for i in range(7)]
    have = [(n, d) for n in nodes[:15] for d in days]
    frame = lambda rows: spark.createDataFrame(rows, "node string, fecha date")
    count = lambda have: sum(len(r["nodes"]) for r in plan(spark, nodes[:30], start, end, frame(have)))
    assert count(have) == 15
    assert count(have[1:]) == 16
    assert count([(n, d) for n in nodes[:30] for d in days]) == 0


def test_request_rules(spark):
    many = [f"N{i}" for i in range(21)]
    rows = [("ok", "SIN", "MDA", ["A"], D(2024, 1, 1), D(2024, 1, 7)),
            ("nodes", "SIN", "MDA", many, D(2024, 1, 1), D(2024, 1, 1)),
            ("none", "SIN", "MDA", [], D(2024, 1, 1), D(2024, 1, 1)),
            ("days", "SIN", "MDA", ["A"], D(2024, 1, 1), D(2024, 1, 8)),
            ("order", "SIN", "MDA", ["A"], D(2024, 1, 2), D(2024, 1, 1)),
            ("system", "X", "MDA", ["A"], D(2024, 1, 1), D(2024, 1, 1)),
            ("market", "SIN", "X", ["A"], D(2024, 1, 1), D(2024, 1, 1))]
    frame = spark.createDataFrame(
        rows, 'name string, sistema string, proceso string, nodes array<string>, start date, `end` date')
    out = {r["name"]: r["reject_reason"] for r in planning.validate_requests(frame).collect()}
    assert out.pop("ok") is None and all(out.values()) and len(set(out.values())) == 5


def test_requested_pairs(spark):
    rows = [(["A", "B"], D(2024, 1, 1), D(2024, 1, 3)), (["A"], D(2024, 1, 3), D(2024, 1, 4))]
    frame = spark.createDataFrame(rows, "nodes array<string>, start date, `end` date")
    pairs = planning.requested_pairs(frame)
    assert pairs.count() == 4 + 3
    covered = spark.createDataFrame([("A", D(2024, 1, 1)), ("C", D(2024, 1, 1))], "node string, fecha date")
    assert planning.available_pairs(covered, pairs).count() == 8


SETTINGS = Settings(stats_blocks=7, input_blocks=3)
START = D(2024, 1, 1)


@pytest.fixture(scope="module")
def stored(spark):
    """A: 20 days; B: 20 days with a hole on the last one; C: 5 days; E: foreign system."""
    rows = price_days("A", START, 20, seed=1)
    hole = {(D(2024, 1, 19), h) for h in range(5, 15)}
    rows += price_days("B", START, 20, hole, seed=2)
    rows += price_days("C", START, 5, seed=3)
    rows += price_days("E", START, 20, seed=4)
    return grid.build_grid(hourly_rows(spark, rows), HOURLY).cache()


@pytest.fixture(scope="module")
def known(spark):
    rows = [("A", "SIN", "R", "Z", 115.0), ("B", "SIN", "R", "Z", 115.0), ("C", "SIN", "R", "Z", 115.0),
            ("E", "BCA", "R", "Z", 115.0), ("F", "SIN", "R", "Z", 115.0)]
    return spark.createDataFrame(rows, "node string, sistema string, region string, zone string, kv double")


AS_OF = datetime.datetime(2024, 1, 20, 9)


def asked(spark, *pairs):
    return spark.createDataFrame(list(pairs), "node string, target_date date")


def test_forecasts_for_many_nodes(spark, stored, known):
    tomorrow = D(2024, 1, 21)
    requests = asked(spark, *[(n, tomorrow) for n in "ABCEFX"], ("A", D(2024, 1, 15)), ("A", D(2024, 1, 30)))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    built = daily.request_samples(requests, stored, HOURLY, SETTINGS, known)
    reasons = {(r["node"], r["target_date"].day): r["skip_reason"] for r in daily.explain_requests(
        requests, built, stored, as_of, HOURLY, SETTINGS, known).collect()}
    assert reasons == {
        ("A", 21): None, ("A", 15): None, ("A", 30): "target out of range",
        ("B", 21): "too little clean history", ("C", 21): "no published history",
        ("E", 21): "out of scope", ("F", 21): "no published history", ("X", 21): "not in the catalogue",
    }
    open_scope = daily.explain_requests(
        asked(spark, ("E", tomorrow)), built, stored, as_of, HOURLY, SETTINGS).first()
    assert open_scope["skip_reason"] is None
    predicted = built.where("node = 'A'").withColumn("y_pred", F.col("last_block"))
    answers = daily.forecast_answers(predicted, stored, as_of, HOURLY, asked(spark, ("A", tomorrow)))
    by = {r["target_date"].day: r for r in answers.collect()}
    assert by[21]["backtest"] is False and by[21]["issued_at"] == AS_OF
    assert by[15]["backtest"] is True and by[15]["issued_at"] == datetime.datetime(2024, 1, 14, 6)
    assert by[21]["history_end"] == datetime.datetime(2024, 1, 20, 23)
    assert by[21]["evaluated_node"] is True and len(by[21]["hours"]) == 24
    best = by[21]["best_window"]
    hours = [h["pml"] for h in by[21]["hours"]]
    sums = [sum(hours[s : s + 4]) for s in range(21)]
    assert best["end_hour"] - best["start_hour"] == 3 and best["start_hour"] == sums.index(max(sums)) + 1
    table = daily.forecast_table(answers)
    assert table.count() == 48
    price = table.where("hora = 1 AND target_date = '2024-01-21'").first()["pml_pred"]
    assert price == round(price, 2)


def test_a_live_sample_equals_its_later_backtest(spark, stored):
    target = asked(spark, ("A", D(2024, 1, 18)))
    past = stored.where("fecha <= '2024-01-17'")
    columns = ["node", "mu", "sigma", "X_seq", "X_cal", "X_level", "last_block"]
    live = daily.request_samples(target, past, HOURLY, SETTINGS).select(*columns, "y").first()
    later = daily.request_samples(target, stored, HOURLY, SETTINGS).select(*columns, "y").first()
    assert all(live[c] == later[c] for c in columns)
    assert live["y"] == [None] * 24 and None not in later["y"]


def test_next_targets(spark, stored):
    at = lambda t: {r["node"]: r for r in daily.next_targets(
        stored, F.lit(t).cast("timestamp_ntz"), HOURLY, SETTINGS).collect()}
    morning = at(AS_OF)
    assert morning["A"]["target_date"] == D(2024, 1, 21) and not morning["A"]["is_late"]
    assert at(AS_OF.replace(hour=19))["A"]["is_late"]
    assert at(datetime.datetime(2024, 1, 21, 9))["A"]["target_date"] is None


def test_scoring_and_recent_skill(spark, stored, tmp_path):
    days = [D(2024, 1, d) for d in (3, 15, 19, 25)]
    rows = [(n, d, h, 800.0 + h) for n in "AB" for d in days for h in range(1, 25)]
    forecasts = spark.createDataFrame(rows, "node string, target_date date, hora int, pml_pred double")
    scores = daily.score_published(forecasts, stored, HOURLY)
    by = {(r["node"], r["target_date"].day): r for r in scores.collect()}
    # the 25th is not published and B has a hole on the 19th
    assert set(by) == {("A", 3), ("A", 15), ("A", 19), ("B", 3), ("B", 15)}
    actual = {(r["fecha"].day, r["hora"]): r["pml"] for r in stored.where("node = 'A'").collect()}
    err = lambda d, f: sum(abs(actual[(d, h)] - f(h)) for h in range(1, 25)) / 24
    one = by[("A", 15)]
    assert one["mae"] == pytest.approx(err(15, lambda h: 800.0 + h))
    assert one["naive24_mae"] == pytest.approx(err(15, lambda h: actual[(14, h)]))
    assert one["naive168_mae"] == pytest.approx(err(15, lambda h: actual[(8, h)]))
    assert one["skill_vs_naive24"] == pytest.approx(1 - one["mae"] / one["naive24_mae"])
    assert by[("A", 3)]["naive168_mae"] is None and by[("A", 3)]["naive24_mae"] is not None
    path = str(tmp_path / "scores")
    gold.append_scores(scores.where("target_date < '2024-01-16'"), path)
    fresh = daily.score_published(forecasts, stored, HOURLY, spark.read.parquet(path))
    assert [(r["node"], r["target_date"].day) for r in fresh.collect()] == [("A", 19)]
    gold.append_scores(fresh, path)
    everything = spark.read.parquet(path)
    recent = daily.recent_skill(everything, 4).first()
    assert (recent["days"], recent["nodes"]) == (1, 1)
    assert recent["mae"] == pytest.approx(by[("A", 19)]["mae"])
    assert daily.recent_skill(everything, 30).first()["days"] == 3
    assert daily.latest_scored(everything).first()["target_date"] == D(2024, 1, 19)
    assert daily.latest_scored(everything, "B").first()["target_date"] == D(2024, 1, 15)


def test_reruns_replace_the_same_day_only(spark, tmp_path):
    path = str(tmp_path / "forecasts")
    make = lambda day, price: spark.createDataFrame(
        [("A", day, h, price) for h in range(1, 3)], "node string, target_date date, hora int, pml_pred double")
    gold.merge_forecasts(make(D(2024, 1, 1), 1.0), path)
    gold.merge_forecasts(make(D(2024, 1, 2), 2.0), path)
    gold.merge_forecasts(make(D(2024, 1, 2), 3.0), path)
    rows = spark.read.parquet(path)
    got = {(r["target_date"].day, r["pml_pred"]) for r in rows.collect()}
    assert got == {(1, 1.0), (2, 3.0)} and rows.count() == 4
    pure = daily.replace_targets(make(D(2024, 1, 1), 1.0), make(D(2024, 1, 1), 9.0))
    assert {r["pml_pred"] for r in pure.collect()} == {9.0}


def test_freshness(stored):
    assert coverage.freshness(stored).first()["last_day"] == D(2024, 1, 20)


def test_model_card_and_node_options(spark, stored, known):
    built = samples.build_samples(stored.where("node = 'A'"), HOURLY, SETTINGS, known)
    from loomgrid.operators import splits
    from loomgrid.plans import dataset
    from loomgrid.sources import catalog

    labelled = splits.assign_splits(built, Settings(test_months=0, val_days=3))
    nodes = labelled.select("node", "zone", "kv").distinct()
    meta = dataset.dataset_meta(labelled, nodes, known, "card", HOURLY, SETTINGS)
    scores = spark.createDataFrame(
        [("A", D(2024, 1, 15), 5.0, 0.5, 0.9, 0.1)],
        "node string, target_date date, mae double, top4_overlap double, captured_value double,"
        " skill_vs_naive24 double")
    card = daily.model_card(meta, scores, stored).first()
    assert (card["dataset"], card["nodes"], card["recent_mae"]) == ("card", 1, 5.0)
    assert card["last_day"] == D(2024, 1, 20) and card["scaling_days"] == 7
    named = known.selectExpr("*", "concat('name ', node) AS name", "'m' AS municipality", "'s' AS state")
    listed = known.where("node <> 'A'").unionByName(
        known.where("node = 'A'").withColumn("node", F.lit("Q")))
    rows = catalog.node_options(listed, named.where("node <> 'B'")).collect()
    assert [r["node"] for r in rows] == ["B", "C", "E", "F", "Q"]
    assert rows[0]["name"] is None and rows[1]["name"] == "name C"
