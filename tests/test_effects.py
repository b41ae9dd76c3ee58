import datetime

import numpy as np
import pytest
from conftest import HOURLY
from pyspark.sql import functions as F

from loomgrid.config import RIDGE_ALPHAS, Settings
from loomgrid.plans import dataset, selection
from loomgrid.session import stage

SETTINGS = Settings(test_months=1, val_days=14, input_blocks=3)


@pytest.fixture(scope="module")
def ds(three_series, three_nodes, spark):
    """Four nodes in two zones, one more in none."""
    twins = {"SUN-3": "SUN-4", "KITE-2": "KITE-9"}
    rows = three_series
    for old, new in twins.items():
        shift = 1.0 + 0.002 * F.dayofyear("fecha") + 0.05 * F.hour("ts_local") / 24
        other = three_series.where(F.col("node") == old).withColumn("node", F.lit(new))
        rows = rows.unionByName(other.withColumn("pml", F.col("pml") * shift))
    places = {"SUN-4": "BAYSIDE", "KITE-9": None}
    added = [(n, "SIN", "ORIENTAL", z, 85.0) for n, z in places.items()]
    catalog = three_nodes.unionByName(spark.createDataFrame(added, three_nodes.schema))
    built = dataset.build_dataset(rows, catalog, "five", HOURLY, SETTINGS, sequences=False)
    kept = built.samples.where(F.col("origin_date") >= F.lit(datetime.date(2022, 1, 1)))
    return dataset.Dataset(stage(kept), built.meta, HOURLY, SETTINGS)


def one_hot(labels, known):
    return np.array([[float(v == k) for k in known] for v in labels]).reshape(len(labels), len(known))


def brute_force(ds):
    """Errors of every fold and kind with one-hot columns built and penalised like any other."""
    rows, p = selection._ridge_rows(ds, True)
    own = p - 9
    pdf = rows.select("node", "zone", "split", "x", "t", "mu", "sigma", "y_price").toPandas()
    x, t = np.vstack(pdf["x"]), np.vstack(pdf["t"])
    price, mu, sigma = np.vstack(pdf["y_price"]), pdf["mu"].to_numpy()[:, None], pdf["sigma"].to_numpy()[:, None]
    zones = sorted(set(pdf["zone"]) - {"UNKNOWN"})
    nodes = sorted(set(pdf["node"]))
    split = pdf["split"].to_numpy()
    out = {}
    # the first three nodes of a shared zone in order; both zones
    for regime, labels in {"node": ["DAM-1", "KITE-2", "SUN-3"], "zone": zones}.items():
        for label in labels:
            inside = (pdf[regime] == label).to_numpy()
            for kind in selection.KINDS:
                v = x[:, :own] if kind == "history" else x
                if kind != "history":
                    seen = [z for z in zones if not (regime == "zone" and z == label)]
                    v = np.hstack([v, one_hot(pdf["zone"], seen)])
                if kind == "node_id":
                    seen = [n for n in nodes if not (pdf["node"][inside] == n).any()]
                    v = np.hstack([v, one_hot(pdf["node"], seen)])

                def fitted(where, alpha):
                    a, b = v[where], t[where]
                    m, n = a.mean(0), b.mean(0)
                    coef = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(v.shape[1]), (a - m).T @ (b - n))
                    return mu + sigma * (v @ coef + n - m @ coef)

                def error(told, where):
                    return np.abs(told - price)[where].mean()

                train, val = ~inside & (split == "train"), ~inside & (split == "val")
                alpha = min(RIDGE_ALPHAS, key=lambda a: error(fitted(train, a), val))
                out[regime, label, kind] = error(fitted(train | val, alpha), inside & (split == "test"))
    return out


def test_folds_equal_ridge_regressions_on_one_hot_columns(spark, ds, tmp_path):
    selection.holdout_forecasts(ds).write.parquet(str(tmp_path / "forecasts"))
    stored = spark.read.parquet(str(tmp_path / "forecasts"))
    folds = selection.fold_errors(stored, SETTINGS.top_k).collect()
    wanted = brute_force(ds)
    found = {(r["regime"], r["held_out"], r["model"]): r["mae"] for r in folds}
    ridge = {k: v for k, v in found.items() if not k[2].startswith("naive")}
    assert set(ridge) == set(wanted) and len(found) == len(wanted) // 3 * 5
    for key, mae in wanted.items():
        assert ridge[key] == pytest.approx(mae, rel=1e-7), key
    assert len({round(v, 6) for v in ridge.values()}) > len(ridge) // 2
    # both regimes come from one pass as from two
    alone = {(r["held_out"], r["model"]): r["mae"] for r in selection.holdout(ds, "node").collect()}
    assert alone == pytest.approx({(h, m): v for (r, h, m), v in found.items() if r == "node"})


def test_holdout_of_nothing(ds):
    empty = dataset.Dataset(ds.samples.where("false"), ds.meta, HOURLY, SETTINGS)
    assert selection.holdout_forecasts(empty).count() == 0
    no_train = dataset.Dataset(ds.samples.where("split = 'test'"), ds.meta, HOURLY, SETTINGS)
    assert {r["model"] for r in selection.holdout(no_train, "zone").collect()} == {"naive24", "naive168"}
