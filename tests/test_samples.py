import datetime

import numpy as np
import pytest
from conftest import HOURLY, silver_from_days
from pyspark.sql import functions as F

from loomgrid.config import Settings
from loomgrid.operators import samples, splits
from loomgrid.plans import dataset
from loomgrid.sources import gold

OK = ["ok"] * 24
LOOSE = Settings(stats_blocks=1, min_coverage=0.1)


def origin_days(spark, qualities, settings=LOOSE):
    silver = silver_from_days(spark, qualities)
    rows = samples.valid_origins(silver, HOURLY.with_chunks(4), settings).collect()
    return sorted((r["origin_date"] - datetime.date(2024, 1, 1)).days for r in rows)


def with_interp(n):
    return ["interp"] * n + ["ok"] * (24 - n)


@pytest.mark.parametrize("w,count", [(7, 5), (3, 9), (20, 0)])
def test_number_of_origins(spark, w, count):
    settings = Settings(stats_blocks=1, min_coverage=0.1, input_blocks=w)
    assert len(origin_days(spark, [OK] * 12, settings)) == count


def test_origin_rules(spark):
    days = [OK] * 12
    assert origin_days(spark, days) == [6, 7, 8, 9, 10]
    missing = list(days)
    missing[9] = ["missing"] + ["ok"] * 23
    assert origin_days(spark, missing) == [6, 7]
    target = list(days)
    target[10] = with_interp(1)
    assert origin_days(spark, target) == [6, 7, 8, 10]
    many = list(days)
    many[7] = with_interp(13)
    assert origin_days(spark, many) == []


def test_strict_nulls_drop_observed_rows_without_price(spark):
    prices = [[100.0] * 24 for _ in range(12)]
    prices[8][3] = None
    silver = silver_from_days(spark, [OK] * 12, prices)
    assert samples.valid_origins(silver, HOURLY, LOOSE).count() == 5
    strict = Settings(stats_blocks=1, min_coverage=0.1, strict_nulls=True)
    # day 8 lies in the target of origin 7 and in the input of origins 8..10
    assert samples.valid_origins(silver, HOURLY, strict).count() == 1


@pytest.fixture(scope="module")
def ds(three_series, three_nodes):
    settings = Settings(test_months=1, val_days=14)
    return dataset.build_dataset(three_series, three_nodes, "small", HOURLY, settings)


def test_sample_count_of_a_clean_node(ds):
    assert ds.samples.where("node = 'KITE-2'").count() == 210


def test_inputs_and_targets_match_the_series(ds, three_series):
    prices = {
        (r["node"], r["ts_local"]): r
        for r in three_series.where("node = 'DAM-1'").collect()
    }
    for s in ds.samples.where("node = 'DAM-1'").orderBy("origin_date").limit(5).collect():
        x = np.array(s["X_seq"])
        assert x.shape == (168, 9) and len(s["X_cal"]) == 10 and len(s["y"]) == 24
        start = datetime.datetime.combine(s["origin_date"], datetime.time()) - datetime.timedelta(days=6)
        for i in (0, 50, 167):
            row = prices[("DAM-1", start + datetime.timedelta(hours=i))]
            assert s["mu"] + s["sigma"] * x[i, 0] == pytest.approx(row["pml"], abs=0.05)
            assert s["comp_mu"][0] + s["sigma"] * x[i, 1] == pytest.approx(row["pml_ene"], abs=0.05)
        total = x[:, 1:4].sum(axis=1) * s["sigma"] + sum(s["comp_mu"])
        np.testing.assert_allclose(total, x[:, 0] * s["sigma"] + s["mu"], atol=0.1)
        target = datetime.datetime.combine(s["target_date"], datetime.time(10))
        assert s["mu"] + s["sigma"] * s["y"][10] == pytest.approx(
            prices[("DAM-1", target)]["pml"], abs=0.05
        )
        assert np.argmax(s["X_cal"][:7]) == s["target_date"].weekday()


def test_nothing_after_the_origin_reaches_the_inputs(three_series):
    cut = datetime.date(2022, 2, 15)
    node = three_series.where("node = 'KITE-2'")
    changed = node.withColumn("pml", F.when(F.col("fecha") > F.lit(cut), 9e9).otherwise(F.col("pml")))
    columns = ["X_seq", "X_cal", "X_level", "mu", "sigma", "last_block", "week_block"]
    pick = lambda df: samples.build_samples(df, HOURLY).where(
        F.col("origin_date") == F.lit(cut)).select(*columns, "y_price").first()
    before, after = pick(node), pick(changed)
    assert all(before[c] == after[c] for c in columns)
    assert before["y_price"] != after["y_price"]


def test_ids_are_dense_and_ordered(ds):
    rows = ds.samples.select("sample_id", "node", "origin_date", "node_idx").collect()
    ordered = sorted(rows, key=lambda r: (r["node"], r["origin_date"]))
    assert [r["sample_id"] for r in ordered] == list(range(len(rows)))
    assert {r["node"]: r["node_idx"] for r in rows} == {"DAM-1": 0, "KITE-2": 1, "SUN-3": 2}


def test_splits_are_ordered(ds):
    by = {r["split"]: r for r in ds.samples.groupBy("split").agg(
        F.min("target_date").alias("a"), F.max("target_date").alias("b"),
        F.countDistinct("target_date").alias("n")).collect()}
    assert by["train"]["b"] < by["val"]["a"] and by["val"]["b"] < by["test"]["a"]
    assert by["val"]["n"] == 14
    walk = splits.target_days(ds.index, "test").collect()
    assert sum(r["n_samples"] for r in walk) == ds.positions("test").count()
    assert [r["target_date"] for r in walk] == sorted(r["target_date"] for r in walk)


def test_metadata_row(ds):
    meta = ds.meta.first()
    assert meta["zone_vocab"] == {"UNKNOWN": 0, "BAYSIDE": 1, "NORTHSHORE": 2}
    assert meta["voltage_log_mean"] == pytest.approx(np.log([115, 230, 400]).mean())
    assert meta["n_samples"]["test"] == ds.positions("test").count()
    assert meta["scaling"]["window_days"] == 28


def test_folds(ds):
    nodes = splits.node_folds(ds.index).orderBy("fold").collect()
    assert [r["held_out"] for r in nodes] == ["KITE-2", "SUN-3"]
    zones = splits.zone_folds(ds.index)
    assert [r["held_out"] for r in zones.orderBy("fold").collect()] == ["NORTHSHORE", "BAYSIDE"]
    roles = splits.fold_roles(ds.index, zones, "zone").collect()
    for r in roles:
        assert (r["zone"] == r["held_out"]) == (r["role"] == "test")
    counts = {r["held_out"]: r for r in splits.fold_counts(ds.index, zones, "zone").collect()}
    assert counts["NORTHSHORE"]["n_test"] == sum(
        r["role"] == "test" and r["held_out"] == "NORTHSHORE" for r in roles)


def test_model_inputs_and_zone_override(ds):
    held = dataset.model_inputs(ds.samples, "metadata", zone_override=0)
    assert held.columns == ["sample_id", "X_seq", "X_cal", "X_level", "X_meta", "zone_idx"]
    assert [r[0] for r in held.select("zone_idx").distinct().collect()] == [0]
    with pytest.raises(ValueError):
        dataset.model_inputs(ds.samples, "other")
    dropped = splits.zone_dropout(ds.samples, 1.0)
    assert [r[0] for r in dropped.select("zone_idx").distinct().collect()] == [0]


def test_dataset_round_trip(spark, ds, tmp_path):
    path = str(tmp_path / "ds")
    gold.save_dataset(ds, path)
    back = gold.load_dataset(spark, path, ds.spec, ds.settings)
    assert back.samples.count() == ds.samples.count()
    assert back.meta.first()["name"] == "small"
    a = ds.target_prices().orderBy("sample_id").first()["y_price"]
    b = back.target_prices().orderBy("sample_id").first()["y_price"]
    assert a == b


def test_whole_block_check(spark, three_series):
    assert samples.assert_whole_blocks(three_series, HOURLY).isEmpty()
    assert not samples.assert_whole_blocks(three_series.where("hora <> 7"), HOURLY).isEmpty()


def test_unknown_entities_get_default_metadata(three_series, three_nodes):
    known = three_nodes.where("node = 'DAM-1'")
    rows = samples.node_metadata(three_series.select("node").distinct(), known, HOURLY).collect()
    by = {r["node"]: r for r in rows}
    assert by["KITE-2"]["region"] == "UNKNOWN" and by["KITE-2"]["kv"] is None
    assert by["DAM-1"]["zone"] == "BAYSIDE"
