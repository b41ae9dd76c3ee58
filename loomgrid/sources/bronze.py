"""Landed request envelopes and the records inside their bodies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.config import RETRY_STATUSES, TIME_ZONE, SeriesSpec
from loomgrid.operators.cleaning import first_observed, records_to_hourly
from loomgrid.operators.grid import build_grid
from loomgrid.operators.planning import request_key
from loomgrid.schemas import ENVELOPE, SILVER_COLUMNS

ENVELOPE_FILES = "*.{json,json.gz}"
# Spellings found in response bodies.
MESSAGE_KEYS = ("Message", "message", "mensaje", "Mensaje")
MESSAGE_TEXT = "no se pueden"
RESULT_KEYS = ("Resultados", "resultados")
NODE_KEYS = ("clv_nodo", "nodo", "clave")
VALUE_KEYS = ("Valores", "valores")
PRICE_KEYS = ("pml", "pml_ene", "pml_per", "pml_cng")


def read_envelopes(
    spark: SparkSession, path: str, sistema: str | None = None, market: str | None = None
) -> DataFrame:
    """All request envelopes under a folder, plain or gzipped, with their path."""
    rows = (
        spark.read.schema(ENVELOPE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", ENVELOPE_FILES)
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    if sistema is not None:
        rows = rows.where(F.col("sistema") == sistema)
    if market is not None:
        rows = rows.where(F.col("proceso") == market)
    return rows


def request_index(envelopes: DataFrame) -> DataFrame:
    """Envelopes without their body, plus their key and whether they had one."""
    has_body = F.coalesce(F.length("body") > 0, F.lit(False))
    return request_key(envelopes).withColumn("has_body", has_body).drop("body")


def _get(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _first(v: Column, keys: tuple[str, ...], kind: str, blank: bool = False) -> Column:
    found = [_get(v, k, kind) for k in keys]
    if blank:
        found = [F.when(x != "", x) for x in found]
    return F.coalesce(*found)


def _message(v: Column, body: Column) -> Column:
    """Service message of an object body, under a known key or by its wording."""
    texts = F.filter(
        F.map_values(F.try_variant_get(v, "$", "map<string,variant>")),
        lambda x: F.schema_of_variant(x) == "STRING",
    )
    worded = F.filter(
        F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")),
        lambda t: F.lower(t).contains(MESSAGE_TEXT),
    )
    # most bodies are long price lists without the wording; only the others are taken apart
    by_wording = F.when(F.lower(body).contains(MESSAGE_TEXT), F.get(worded, F.lit(0)))
    return F.coalesce(_first(v, MESSAGE_KEYS, "string", blank=True), by_wording)


def parse_bodies(rows: DataFrame, body: str = "body") -> DataFrame:
    """Add ``items`` (array of node results) and ``message`` parsed from a JSON body.

    Tolerates object and list bodies and several key spellings. Blank bodies give
    neither items nor a message; text that is not JSON gives a message.
    """
    text = F.regexp_replace(F.col(body), r"^\s+", "")
    parsed = rows.withColumns(
        {"_v": F.try_parse_json(F.col(body)), "_open": F.substring(text, 1, 1)}
    )
    v = F.col("_v")
    # the first character of valid JSON tells its kind
    is_list, is_object = F.col("_open") == "[", F.col("_open") == "{"
    parsed = parsed.withColumn("_own", F.when(is_object, _message(v, F.col(body))))
    own = F.col("_own")
    message = (
        F.when(F.coalesce(F.col("_open") == "", F.lit(True)), F.lit(None).cast("string"))
        .when(v.isNull(), "invalid json")
        .when(is_object, own)
        .when(~is_list, "unexpected payload")
    )
    items = F.when(is_list, F.try_variant_get(v, "$", "array<variant>")).when(
        is_object & own.isNull(), _first(v, RESULT_KEYS, "array<variant>")
    )
    return parsed.withColumns({"items": items, "message": message}).drop("_v", "_open", "_own")


def explode_records(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Flat price records of parsed bodies, with their position inside the body.

    ``keep`` names the columns carried along; ``item_pos`` and ``value_pos`` are the
    arrival order of the records of one body.
    """
    items = parsed.select(*keep, F.posexplode("items").alias("item_pos", "item"))
    item = F.col("item")
    node = F.trim(_first(item, NODE_KEYS, "string", blank=True))
    values = items.select(
        *keep,
        "item_pos",
        node.alias("node"),
        F.posexplode(_first(item, VALUE_KEYS, "array<variant>")).alias("value_pos", "value"),
    )
    value = F.col("value")
    flat = values.select(
        *keep,
        "item_pos",
        "value_pos",
        "node",
        F.substring(_get(value, "fecha", "string"), 1, 10).alias("fecha"),
        F.expr("try_cast(try_cast(try_variant_get(value, '$.hora', 'string') AS double) AS int)")
        .alias("hora"),
        *[
            F.expr(
                f"try_cast(replace(try_variant_get(value, '$.{k}', 'string'), ',', '') AS double)"
            ).alias(k)
            for k in PRICE_KEYS
        ],
    )
    return flat.where("node IS NOT NULL AND hora IS NOT NULL AND fecha <> ''")


def classify(parsed: DataFrame, status: str = "status_code") -> DataFrame:
    """Add ``n_records`` and ``event``: error, not_found, message, empty or ok."""
    code = F.col(status)

    def count(item: Column) -> Column:
        values = _first(item, VALUE_KEYS, "array<variant>")
        good = F.filter(
            values,
            lambda x: F.try_variant_get(x, "$.fecha", "string").isNotNull()
            & (F.try_variant_get(x, "$.fecha", "string") != "")
            & F.try_variant_get(x, "$.hora", "double").isNotNull(),
        )
        named = _first(item, NODE_KEYS, "string", blank=True).isNotNull()
        return F.when(named, F.coalesce(F.size(good), F.lit(0))).otherwise(F.lit(0))

    total = F.aggregate(
        F.transform(F.coalesce("items", F.array().cast("array<variant>")), count),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    event = (
        F.when(code.isNull() | code.isin(list(RETRY_STATUSES)) | (code >= 500), "error")
        .when(code == 404, "not_found")
        .when(F.col("message").isNotNull(), "message")
        .when((code == 204) | (F.col("n_records") == 0), "empty")
        .when(code == 200, "ok")
        .otherwise("error")
    )
    return parsed.withColumn("n_records", total).withColumn("event", event)


def collection_summary(classified: DataFrame) -> DataFrame:
    """Requests and records per event class."""
    return classified.groupBy("event").agg(
        F.count("*").alias("n_requests"), F.sum("n_records").alias("n_records")
    )


def envelope_rows(
    envelopes: DataFrame, spec: SeriesSpec, tz: str = TIME_ZONE, ingested_at: Column | None = None
) -> DataFrame:
    """Observed rows of every envelope, each envelope cleaned on its own.

    The records of a day are those of one body, so they are shuffled and sorted once.
    """
    parsed = parse_bodies(
        envelopes.select("path", "sistema", F.col("proceso").alias("market"), "body")
    )
    records = explode_records(parsed, ["path", "sistema", "market"])
    per_body = replace(spec, keys=("path", *spec.keys))
    return records_to_hourly(
        records, per_body, ["item_pos", "value_pos"], tz=tz, ingested_at=ingested_at, by_day=True
    )


def rebuild_silver(
    envelopes: DataFrame, spec: SeriesSpec, max_interp: int = 3, tz: str = TIME_ZONE
) -> DataFrame:
    """Silver grids derived again from every envelope; the first path wins.

    Markets are kept apart whether or not the key names them.
    """
    spec = spec if "market" in spec.keys else replace(spec, keys=("market", *spec.keys))
    rows = envelope_rows(envelopes, spec, tz)
    unique = first_observed(rows, spec, ["path"])
    return build_grid(unique.select(*dict.fromkeys([*spec.keys, *SILVER_COLUMNS])), spec, max_interp)
