"""Node catalogues: reading, cleaning, versions, selection and coverage."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.config import STAGE_QUOTAS, STAGE_REGION, UNKNOWN
from loomgrid.functions.encoding import normalize_header, parse_version
from loomgrid.schemas import CATALOG_COLUMNS, NODE_LIST_COLUMNS

# Source headers (normalised) and the columns they fill.
HEADERS = {
    "SISTEMA": "sistema",
    "CENTRO DE CONTROL REGIONAL": "region",
    "ZONA DE CARGA": "zone",
    "CLAVE": "node",
    "NOMBRE": "name",
    "NIVEL DE TENSION (KV)": "kv",
    "ZONA DE OPERACION DE TRANSMISION": "transmission_zone",
    "GERENCIA REGIONAL DE TRANSMISION": "transmission_mgmt",
    "ZONA DE DISTRIBUCION": "distribution_zone",
    "GERENCIA DIVISIONAL DE DISTRIBUCION": "distribution_division",
    "CLAVE DE ENTIDAD FEDERATIVA (INEGI)": "state_code",
    "ENTIDAD FEDERATIVA (INEGI)": "state",
    "CLAVE DE MUNICIPIO (INEGI)": "municipality_code",
    "MUNICIPIO (INEGI)": "municipality",
    "REGION DE TRANSMISION": "transmission_region",
}
# Repeated flag headers; the first of a pair is load, the second generation.
FLAG_HEADERS = {
    "DIRECTAMENTE MODELADA": ("load_direct", "gen_direct"),
    "INDIRECTAMENTE MODELADA": ("load_indirect", "gen_indirect"),
}
NOT_APPLICABLE = "NO APLICA"
FALSE_TEXT = ("", "0", "NO", "NAN", "NONE")
CODES = ("state_code", "municipality_code")


def _header_line(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError("empty file")
    return next(csv.reader([line[0].lstrip("\ufeff")]))


def column_positions(header: list[str]) -> dict[str, int]:
    """Position of every known column in a raw header."""
    labels = [normalize_header(h) for h in header]
    out = {}
    for label, target in HEADERS.items():
        if label not in labels:
            raise ValueError(f"catalog column missing: {label}")
        out[target] = labels.index(label)
    bases = [re.sub(r"\.\d+$", "", label) for label in labels]
    for label, targets in FLAG_HEADERS.items():
        found = [i for i, base in enumerate(bases) if base == label]
        out.update(zip(targets, found))
    return out


def _flag(value: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return ~text.isin(list(FALSE_TEXT))


def clean_catalog(raw: DataFrame, version: str) -> DataFrame:
    """Catalogue rows from raw text columns; the first row of a repeated node stays.

    ``raw`` has one text column per catalogue column it knows and ``row_order``.
    """
    flags = [t for pair in FLAG_HEADERS.values() for t in pair]
    number = {"kv": "double", **{c: "bigint" for c in CODES}}
    columns = {}
    for c in CATALOG_COLUMNS:
        if c in ("catalog_version", "loaded_at"):
            continue
        known = F.col(c) if c in raw.columns else F.lit(None).cast("string")
        if c in flags:
            columns[c] = _flag(known)
        elif c in number:
            columns[c] = F.trim(known).try_cast("double").cast(number[c])
        else:
            columns[c] = F.trim(F.coalesce(known, F.lit("")))
    region = F.col("region")
    unknown = (region == "") | (F.upper(region) == NOT_APPLICABLE)
    rows = raw.select("row_order", *[e.alias(c) for c, e in columns.items()]).where("node <> ''")
    rows = rows.withColumns(
        {
            "region": F.when(unknown, UNKNOWN).otherwise(region),
            "zone": F.when(F.col("zone") == "", UNKNOWN).otherwise(F.col("zone")),
        }
    )
    rest = [c for c in columns if c != "node"]
    unique = rows.groupBy("node").agg(F.min_by(F.struct(*rest), "row_order").alias("kept"))
    return (
        unique.select("node", "kept.*")
        .withColumns({"catalog_version": F.lit(version), "loaded_at": F.current_timestamp()})
        .select(*CATALOG_COLUMNS)
        .orderBy("node")
    )


def read_catalog(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Catalogue from a CSV file, or a Parquet table already in catalogue form."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    version = version or parse_version(path)
    if not version:
        raise ValueError(f"cannot infer the catalog version from {path}; pass version")
    header = _header_line(spark, path)
    names = [f"c{i}" for i in range(len(header))]
    text = (
        spark.read.schema(", ".join(f"{n} string" for n in names))
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("encoding", "UTF-8")
        .csv(path)
    )
    order = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )
    picked = {target: names[i] for target, i in column_positions(header).items()}
    raw = text.select(order.alias("row_order"), *[F.col(n).alias(t) for t, n in picked.items()])
    return clean_catalog(raw, version)


def save_catalog(catalog: DataFrame, path: str) -> None:
    """Write one version of the catalogue, replacing only that version."""
    (
        catalog.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("catalog_version")
        .parquet(path)
    )


def stored_catalog(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A stored version, the newest one by default."""
    table = spark.read.parquet(path).withColumn(
        "catalog_version", F.col("catalog_version").cast("string")
    )
    wanted = (
        F.lit(version)
        if version
        else table.agg(F.max("catalog_version").alias("v")).scalar()
    )
    return table.where(F.col("catalog_version") == wanted)


def read_node_list(spark: SparkSession, path: str) -> DataFrame:
    """Node keys of a CSV list: its ``node`` column, or the first one without header."""
    header = [h.strip().lower() for h in _header_line(spark, path)]
    named = "node" in header
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    rows = spark.read.schema(schema).option("header", str(named).lower()).csv(path)
    node = F.trim(F.col(f"c{header.index('node') if named else 0}"))
    return rows.select(node.alias("node")).where("node <> ''")


def write_node_list(selected: DataFrame, path: str) -> None:
    """Write the node list as one CSV file (a dimension-sized selection)."""
    ordered = selected.select(*NODE_LIST_COLUMNS).orderBy(F.desc("kv"), "region", "node")
    ordered.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def zones_over_regions(catalog: DataFrame) -> DataFrame:
    """Zones that appear in more than one region (empty when nested)."""
    per = catalog.groupBy("zone").agg(F.countDistinct("region").alias("n_regions"))
    return per.where("n_regions > 1")


def select_nodes(
    catalog: DataFrame,
    quotas: dict,
    sistema: str = "SIN",
    region: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Pick nodes per voltage level, spread over regions and then over zones.

    Levels are filled from the highest voltage down. Inside a level the next node
    is of the region with the fewest picks there, then of the zone with the fewest
    picks overall, then the smallest key. With zones nested in regions that order
    is an interleaving of ranks, so a level is two ranking windows and a top-k.
    """
    eligible = catalog.where((F.col("sistema") == sistema) & (F.col("region") != UNKNOWN))
    if region is not None:
        eligible = eligible.where(F.col("region") == region)
    eligible = eligible.select("node", "region", "zone", "kv")
    if check and not zones_over_regions(eligible).isEmpty():
        raise ValueError("a zone spans several regions")
    picked = None
    for level in sorted(quotas, key=float, reverse=True):
        pool = eligible.where(F.col("kv") == float(level))
        if quotas[level] == "all":
            chosen = pool.select("node", "zone")
        else:
            # rows past the quota of their zone or region can't be chosen, so tasks drop them
            # before the rows of a zone or region meet
            quota = int(quotas[level])
            place = F.row_number().over(Window.partitionBy("zone").orderBy("node"))
            pool = pool.withColumn("place", place).where(F.col("place") <= quota)
            turn = F.col("place") - 1
            if picked is None:
                pool = pool.withColumn("taken", turn)
            else:
                before = picked.groupBy("zone").agg(F.count("*").alias("earlier"))
                pool = pool.join(before, "zone", "left").withColumn(
                    "taken", F.coalesce("earlier", F.lit(0)) + turn
                )
            order = Window.partitionBy("region").orderBy("taken", "node")
            ranked = pool.withColumn("round", F.row_number().over(order)).where(
                F.col("round") <= quota
            )
            chosen = (
                ranked.orderBy("round", "taken", "node")
                .limit(quota)
                .select("node", "zone")
            )
        picked = chosen if picked is None else picked.unionByName(chosen)
    return catalog.join(picked.select("node"), "node", "left_semi").orderBy(
        F.desc("kv"), "region", "node"
    )


def stage_nodes(catalog: DataFrame, stage: int) -> DataFrame:
    """Nodes of a collection stage: its quotas per level, in its region or everywhere."""
    return select_nodes(catalog, STAGE_QUOTAS[stage], region=STAGE_REGION[stage])


def level_crosstab(selected: DataFrame) -> DataFrame:
    """Nodes per region and voltage level with totals; null marks a total."""
    return selected.cube("region", "kv").agg(
        F.count("*").alias("n"),
        F.grouping("region").cast("int").alias("all_regions"),
        F.grouping("kv").cast("int").alias("all_levels"),
    )


def level_pivot(selected: DataFrame, levels: list[float]) -> DataFrame:
    """The cross table in wide form, one column per wanted voltage level.

    ``total`` counts every node of the region, those of other or unknown levels too.
    """
    counts = [F.count_if(F.col("kv") == v).alias(str(v)) for v in levels]
    return selected.groupBy("region").agg(*counts, F.count("*").alias("total"))


def zone_coverage(selected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per region: zones in the catalogue, zones covered, and the uncovered ones."""
    systems = selected.select("sistema").distinct()
    scope = catalog.join(systems, "sistema", "left_semi").where(F.col("region") != UNKNOWN)
    zones = scope.select("region", "zone").distinct()
    covered = selected.select("region", "zone").distinct().withColumn("covered", F.lit(True))
    both = zones.join(covered, ["region", "zone"], "left")
    missing = F.when(F.col("covered").isNull(), F.col("zone"))
    return both.groupBy("region").agg(
        F.count("*").alias("zones"),
        F.count("covered").alias("zones_covered"),
        F.sort_array(F.collect_list(missing)).alias("uncovered"),
    )


def nodes_per_zone(selected: DataFrame) -> DataFrame:
    per = selected.groupBy("zone").agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "zone")


def sample_nodes(index: DataFrame, n: int = 12, per_region: int = 2) -> DataFrame:
    """Deterministic spread of nodes: the first few of each region, then ``n`` overall."""
    nodes = index.select("node", "region", "kv").distinct()
    order = Window.partitionBy("region").orderBy(F.desc("kv"), "node")
    first = nodes.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= per_region
    )
    return first.orderBy("region", F.desc("kv"), "node").limit(n).select("node").orderBy("node")


def node_options(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listed nodes with their catalogue name and place, by region."""
    names = catalog.select("node", "name", "municipality", "state")
    return nodes.select("node", "region", "zone", "kv").join(names, "node", "left").orderBy(
        "region", "node"
    )
