"""The given tables seen as panel series and node catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.config import SeriesSpec, Settings
from loomgrid.functions import clock
from loomgrid.schemas import SILVER_COLUMNS

# events: 30 days of hours; short windows
HOURLY = SeriesSpec()
HOURLY_SETTINGS = Settings(stats_blocks=7, input_blocks=3, max_interp=1)
# lineitem: daily steps in blocks of one week that start on Monday
WEEKLY = SeriesSpec(step_seconds=86400, steps_per_block=7, anchor="1970-01-05")
WEEKLY_SETTINGS = Settings(
    input_blocks=4, stats_blocks=8, week_lag=4, test_months=12, val_days=364
)
# lineitem by supplier nation: weekly steps in blocks of four weeks
MONTHLY = SeriesSpec(step_seconds=7 * 86400, steps_per_block=4, anchor="1970-01-05")
MONTHLY_SETTINGS = Settings(
    input_blocks=4, stats_blocks=8, week_lag=3, top_k=2, test_months=12, val_days=364
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _observed(df: DataFrame, node: Column, ts: Column, value: Column, spec) -> DataFrame:
    """Mean value per (node, step) as observed silver rows with price components.

    Values have two decimals; they are summed in whole hundredths, and divided once, so that a mean does
    not depend on the order of the rows and is the number nearest to the true one.
    """
    slot = clock.slot_of(ts, spec)
    hundredths = F.sum(F.round(value * 100).cast("bigint"))
    steps = df.groupBy(node.alias("node"), slot.alias("slot")).agg(
        (hundredths / (F.count(value) * F.lit(100.0))).alias("pml")
    )
    ene, per = F.col("pml") * 0.9, F.col("pml") * 0.05
    hora = clock.hora_of_slot(F.col("slot"), spec)
    return steps.select(
        "node",
        F.lit("MDA").alias("market"),
        F.lit("SIN").alias("sistema"),
        clock.ts_of_slot(F.col("slot"), spec).alias("ts_local"),
        clock.date_of_block(clock.block_of_slot(F.col("slot"), spec), spec).alias("fecha"),
        hora.alias("hora"),
        "pml",
        ene.alias("pml_ene"),
        per.alias("pml_per"),
        (F.col("pml") - ene - per).alias("pml_cng"),
        F.lit("ok").alias("quality"),
        hora.alias("source_hora"),
        F.lit(None).cast("timestamp").alias("ingested_at"),
    ).select(*SILVER_COLUMNS)


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _observed(events, F.col("event_type"), F.col("ts"), F.col("value"), HOURLY)


def ship_days(spark: SparkSession, sf_dir: str, node: Column | None = None) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    key = F.col("l_returnflag") if node is None else node
    return _observed(items, key, F.col("l_shipdate"), F.col("l_extendedprice"), WEEKLY)


def nation_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    sold = items.join(suppliers, items.l_suppkey == suppliers.s_suppkey).join(
        nations, suppliers.s_nationkey == nations.n_nationkey
    )
    return _observed(
        sold, F.col("n_name"), F.col("l_shipdate"), F.col("l_extendedprice"), MONTHLY
    )


def _kv(key: Column) -> Column:
    return F.element_at(F.array(F.lit(115.0), F.lit(230.0), F.lit(400.0)), (key % 3 + 1).cast("int"))


def nation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as catalogue entries; the region serves as zone and region."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.col("n_name").alias("node"),
        F.col("n_name").alias("name"),
        F.lit("SIN").alias("sistema"),
        F.col("r_name").alias("region"),
        F.col("r_name").alias("zone"),
        _kv(F.col("n_nationkey")).alias("kv"),
    )


def customer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as catalogue entries; zone = nation, nested in region."""
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return (
        customers.join(nations, customers.c_nationkey == nations.n_nationkey)
        .join(regions, nations.n_regionkey == regions.r_regionkey)
        .select(
            F.col("c_name").alias("node"),
            F.col("c_mktsegment").alias("name"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "BCA")
            .otherwise("SIN")
            .alias("sistema"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("zone"),
            _kv(F.col("c_custkey")).alias("kv"),
        )
    )


def order_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A holiday dimension derived from the data: days without urgent orders."""
    orders = table(spark, sf_dir, "orders")
    days = orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    return days.where("urgent = 0").select("date")
