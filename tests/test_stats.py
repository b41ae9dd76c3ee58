import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import HOURLY, silver_from_days
from pyspark.sql import functions as F

from loomgrid.config import SeriesSpec, Settings
from loomgrid.functions import scaling
from loomgrid.operators import coverage, numbering, quality, stats

OK = ["ok"] * 24


@pytest.mark.parametrize("chunk", [5, 64])
def test_rolling_stats_match_brute_force(three_series, chunk):
    spec = HOURLY.with_chunks(chunk)
    got = stats.rolling_stats(three_series, spec).toPandas()
    rows = three_series.toPandas().sort_values(["node", "ts_local"])
    for node, g in rows.groupby("node"):
        price = g.set_index("ts_local")["pml"].astype(float)
        roll = price.rolling(672, min_periods=605)
        want = pd.DataFrame(
            {"mu": roll.mean(), "std": roll.std(ddof=0), "n": roll.count(),
             "mu_7d": price.rolling(168, min_periods=1).mean()}
        )
        want = want[want.index.hour == 23]
        mine = got[got["node"] == node].sort_values("origin")
        assert len(mine) == len(want)
        for a, b in (("mu", "mu"), ("std_raw", "std"), ("n_obs", "n"), ("mu_7d", "mu_7d")):
            np.testing.assert_allclose(
                mine[a].astype(float), want[b], rtol=1e-9, equal_nan=True
            )
        assert not mine["valid"].iloc[23] and np.isnan(mine["sigma"].astype(float).iloc[23])


@pytest.mark.parametrize("level,noise,sigma", [(5.0, 0.0, 10.0), (1000.0, 20.0, 50.0)])
def test_sigma_floors(spark, level, noise, sigma):
    prices = [[level + (noise if h % 2 else -noise) for h in range(24)] for _ in range(30)]
    silver = silver_from_days(spark, [OK] * 30, prices)
    last = stats.rolling_stats(silver, HOURLY).orderBy(F.desc("origin")).first()
    assert last["sigma"] == pytest.approx(sigma, rel=1e-6)
    assert last["mu"] == pytest.approx(level)


def test_level_shift_keeps_the_spread_exact(spark):
    prices = [[5.0] * 24] * 40 + [[1e6] * 24] * 40
    silver = silver_from_days(spark, [OK] * 80, prices)
    rows = stats.rolling_stats(silver, HOURLY).orderBy("origin").collect()
    assert rows[-1]["std_raw"] == pytest.approx(0.0, abs=1.0)
    assert rows[-1]["sigma"] == pytest.approx(50000.0)


@pytest.mark.parametrize(
    "mu,sigma,mu_7d,option,want",
    [(1000.0, 200.0, 1100.0, "sigma_over_1000", [1.0, 0.2, 0.5]),
     (-2.0, 10.0, -2.0, "log1p_sigma", [-0.002, np.log1p(10.0), 0.0])],
)
def test_level_features(spark, mu, sigma, mu_7d, option, want):
    cols = scaling.level_features(F.lit(mu), F.lit(sigma), F.lit(mu_7d), option)
    assert list(spark.range(1).select(*cols).first()) == pytest.approx(want)
    with pytest.raises(ValueError):
        Settings(volatility="other")


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.lognormal(3, 2, 3000) * rng.choice([-1, 1], 3000), 2)
    values[rng.random(3000) < 0.4] = 7.0
    keys = rng.choice(["hot", "cold"], 3000, p=[0.95, 0.05])
    frame = pd.DataFrame({"k": keys, "v": values})
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0}
    df = spark.createDataFrame(frame)
    for r in numbering.exact_quantiles(df, ["k"], "v", probs).collect():
        want = frame.loc[frame["k"] == r["k"], "v"].quantile(list(probs.values()))
        assert [r[n] for n in probs] == pytest.approx(list(want))
    whole = numbering.exact_quantiles(df, [], "v", probs).first()
    assert [whole[n] for n in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))))


def test_numbers_follow_key_order(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), "".join(rng.choice(list("ABab1"), 5)) + str(i)) for i, g in enumerate(rng.integers(0, 3, 300))]
    df = spark.createDataFrame(rows, "g int, k string")
    got = {(r["g"], r["k"]): r["n"] for r in numbering.number_in_order(df, ["g"], "k", "n").collect()}
    for g in range(3):
        ordered = sorted(k for x, k in rows if x == g)
        assert [got[(g, k)] for k in ordered] == list(range(len(ordered)))


def test_coverage_and_quality_tables(three_series):
    table = {r["node"]: r for r in coverage.coverage_table(three_series, HOURLY).collect()}
    assert table["KITE-2"]["days"] == 236 and table["KITE-2"]["full_days"] == 236
    # a short gap on one day and a long one over two days leave three days open
    assert table["SUN-3"]["full_days"] == 233
    dst = quality.dst_rows(three_series, HOURLY).collect()
    found = sorted((r["year"], r["dst_fill"], r["dst_merge"]) for r in dst)
    assert found == [(2021, 0, 1)] * 3 + [(2022, 1, 0)] * 3
    report = quality.quality_report(three_series, HOURLY)
    assert report.headline.first()["n_rows"] == 3 * 236 * 24
    head = report.gap_headline.first()
    assert (head["n_runs"], head["longest_missing"], head["n_interp_runs"]) == (2, 26, 1)
    assert report.sigma.first()["recommendation"] == "sigma_over_1000"


def test_spike_days_use_statistics_of_the_day_before(spark):
    prices = [[100.0 + h % 2 for h in range(24)] for _ in range(32)]
    prices[30][5] = 500.0
    silver = silver_from_days(spark, [OK] * 32, prices, start=datetime.date(2023, 12, 10))
    got = {r["year"]: r["spike_days"] for r in quality.spike_summary(silver, HOURLY).collect()}
    assert got == {2023: 0, 2024: 1}


def test_series_clock_must_cover_whole_days():
    with pytest.raises(ValueError):
        SeriesSpec(step_seconds=3600, steps_per_block=7)
