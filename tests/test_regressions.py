"""Cases that once gave wrong or incomplete results."""

import datetime

import pytest
from conftest import HOURLY, hourly_rows, price_days
from pyspark.sql import functions as F

from loomgrid.operators import grid, numbering, planning, quality, splits
from loomgrid.plans import daily
from loomgrid.sources import catalog, silver
from workload.queries import shipped_hours

SMALL = "/root/testdata/sf0.001"
D = datetime.date


def test_stale_nodes_get_a_reason(spark):
    rows = price_days("FRESH", D(2024, 1, 20), 41) + price_days("STALE", D(2023, 11, 1), 1)
    stored = grid.build_grid(hourly_rows(spark, rows), HOURLY)
    as_of = F.lit("2024-02-29 12:00:00").cast("timestamp_ntz")
    got = {r["node"]: r for r in daily.next_targets(stored, as_of, HOURLY).collect()}
    assert got["FRESH"]["target_date"] == D(2024, 3, 1) and got["FRESH"]["skip_reason"] is None
    assert got["STALE"]["last_day"] is None and got["STALE"]["target_date"] is None
    assert got["STALE"]["is_late"] and got["STALE"]["skip_reason"] is not None


def test_numbers_follow_the_order_of_the_type(spark):
    keys = [2, 5, 10, 99, 100, 1000, 1001, 1010]
    df = spark.createDataFrame([("g", k) for k in keys] + [("h", 7)], "g string, k long")
    got = {(r["g"], r["k"]): r["n"] for r in numbering.number_in_order(df, ["g"], "k", "n").collect()}
    assert got == {**{("g", k): i for i, k in enumerate(keys)}, ("h", 7): 0}
    text = spark.createDataFrame([(f"Customer#{i:05d}",) for i in range(50)], "k string")
    rows = numbering.number_in_order(text, [], "k", "n").collect()
    assert all(r["n"] == int(r["k"][-5:]) for r in rows)


def test_range_parts_are_ordered_and_even(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("k"))
    df = df.union(spark.createDataFrame([(None,)], "k long"))
    parts = df.select("k", numbering.range_part(df, "k", 9).alias("p")).orderBy("k").collect()
    numbers = [r["p"] for r in parts]
    assert numbers == sorted(numbers) and numbers[0] == 0 and max(numbers.count(n) for n in set(numbers)) < 200


def test_markets_stay_apart_in_merges(spark):
    rows = hourly_rows(spark, price_days("N", D(2024, 1, 1), 1))
    both = rows.unionByName(rows.withColumn("market", F.lit("MTR")).withColumn("pml", F.lit(1.0)))
    merged = silver.merge_observed(None, both, HOURLY)
    counts = {r["market"]: r["count"] for r in merged.groupBy("market").count().collect()}
    assert counts == {"MDA": 24, "MTR": 24}
    again = silver.merge_observed(merged.where("quality = 'ok'"), both, HOURLY)
    assert again.count() == 48 and again.where("market = 'MTR' AND pml <> 1").count() == 0


def test_totals_and_years_count_everything(spark):
    nodes = spark.createDataFrame([("A", 400.0), ("A", 115.0), ("A", 69.0), ("A", None)], "region string, kv double")
    row = catalog.level_pivot(nodes, [400.0, 115.0]).first()
    assert (row["400.0"], row["115.0"], row["total"]) == (1, 1, 4)
    spikes = spark.createDataFrame([("N", 1990, 2), ("N", 1993, 1)], "node string, year int, spike_days long")
    wide = quality.spike_pivot(spikes, HOURLY).first()
    assert wide.asDict() == {"node": "N", "1990": 2, "1991": 0, "1992": 0, "1993": 1} or wide["1990"] == 2


def test_dropout_does_not_depend_on_the_layout(spark):
    rows = spark.range(500).select(F.col("id").alias("sample_id"), F.lit(3).alias("zone_idx"))
    draw = lambda df: {tuple(r) for r in splits.zone_dropout(df, 0.3, 4).collect()}
    assert draw(rows) == draw(rows.repartition(7, "zone_idx")) and 90 < sum(z == 0 for _, z in draw(rows)) < 210


def test_all_line_items_reach_an_hour(spark):
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    want = items.agg(F.sum((F.col("l_quantity") % 8 + 1).cast("bigint"))).first()[0]
    assert shipped_hours(spark, SMALL).agg(F.sum("n")).first()[0] == want


def test_real_time_prices_lag(spark):
    row = spark.sql("SELECT DATE'2024-05-20' AS d").select(
        planning.last_published(F.lit("MTR"), F.col("d")), planning.last_published(F.lit("MDA"), F.col("d"))
    ).first()
    assert tuple(row) == (D(2024, 5, 12), D(2024, 5, 21))


def test_stage_nodes_follow_the_quotas(spark):
    rows = [(f"N{i}", "SIN", "PENINSULAR" if i % 2 else "NORTE", f"Z{i % 2}{i % 6}", 115.0) for i in range(60)]
    table = spark.createDataFrame(rows, "node string, sistema string, region string, zone string, kv double")
    assert catalog.stage_nodes(table, 1).count() == 15
    assert {r[0] for r in catalog.stage_nodes(table, 1).select("region").distinct().collect()} == {"PENINSULAR"}
    assert catalog.stage_nodes(table, 2).count() == 17


@pytest.mark.parametrize("market", ["MDA", "MTR"])
def test_plans_end_with_the_last_published_day(spark, market):
    today, start = datetime.date(2024, 3, 15), datetime.date(2024, 3, 1)
    nodes = spark.createDataFrame([("A",), ("B",)], "node string")
    last = spark.range(1).select(planning.last_published(F.lit(market), F.lit(today))).first()[0]
    assert last == planning.last_published_day(market, today)
    planned = planning.plan_requests(nodes, "SIN", market, start, datetime.date(2024, 4, 30), today=today)
    assert planned.agg(F.max("end")).first()[0] == last
    # a range that is not published yet asks for nothing
    late = planning.plan_requests(nodes, "SIN", market, last + datetime.timedelta(days=1), datetime.date(2024, 4, 30), today=today)
    assert late.count() == 0
    # the end that was asked for stays where it is published
    early = planning.plan_requests(nodes, "SIN", market, start, datetime.date(2024, 3, 5), today=today)
    assert early.agg(F.max("end")).first()[0] == datetime.date(2024, 3, 5)
