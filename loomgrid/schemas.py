"""Explicit table schemas; nothing is inferred at read time."""

# Column names and types of stored tables must stay readable by other tools.

from pyspark.sql import types as T

ENVELOPE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("sistema", T.StringType()),
        T.StructField("proceso", T.StringType()),
        T.StructField("nodes", T.ArrayType(T.StringType())),
        T.StructField("start", T.DateType()),
        T.StructField("end", T.DateType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

SILVER = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("sistema", T.StringType()),
        T.StructField("ts_local", T.TimestampNTZType()),
        T.StructField("fecha", T.DateType()),
        T.StructField("hora", T.IntegerType()),
        T.StructField("pml", T.DoubleType()),
        T.StructField("pml_ene", T.DoubleType()),
        T.StructField("pml_per", T.DoubleType()),
        T.StructField("pml_cng", T.DoubleType()),
        T.StructField("quality", T.StringType()),
        T.StructField("source_hora", T.IntegerType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)
SILVER_COLUMNS = SILVER.fieldNames()

CATALOG = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("sistema", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("kv", T.DoubleType()),
        T.StructField("load_direct", T.BooleanType()),
        T.StructField("load_indirect", T.BooleanType()),
        T.StructField("gen_direct", T.BooleanType()),
        T.StructField("gen_indirect", T.BooleanType()),
        T.StructField("transmission_zone", T.StringType()),
        T.StructField("transmission_mgmt", T.StringType()),
        T.StructField("distribution_zone", T.StringType()),
        T.StructField("distribution_division", T.StringType()),
        T.StructField("state_code", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("municipality_code", T.LongType()),
        T.StructField("municipality", T.StringType()),
        T.StructField("transmission_region", T.StringType()),
        T.StructField("catalog_version", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
)
CATALOG_COLUMNS = CATALOG.fieldNames()
NODE_LIST_COLUMNS = ["node", "sistema", "region", "zone", "kv"]

INDEX_COLUMNS = [
    "sample_id",
    "node",
    "sistema",
    "region",
    "zone",
    "kv",
    "origin_date",
    "target_date",
    "split",
    "is_spike_day",
    "n_interp_input",
    "mu",
    "sigma",
    "std_raw",
    "mu_7d",
]

PREDICTION_COLUMNS = [
    "node",
    "market",
    "origin_date",
    "target_date",
    "hora",
    "pml_pred",
    "pml_actual",
    "model_name",
    "model_version",
    "issued_at",
    "run_at",
    "split",
    "sample_id",
]
FORECAST_COLUMNS = [
    "node",
    "market",
    "origin_date",
    "target_date",
    "hora",
    "pml_pred",
    "model_version",
    "issued_at",
    "run_at",
]
SCORE_COLUMNS = [
    "node",
    "target_date",
    "mae",
    "rmse",
    "top4_overlap",
    "captured_value",
    "naive24_mae",
    "naive168_mae",
    "skill_vs_naive24",
    "scored_at",
]
