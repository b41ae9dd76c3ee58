"""Metadata encoders fitted on training entities only."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.config import REGIONS, UNKNOWN


def normalize_header(label: str) -> str:
    """Header label without accents, blanks collapsed, upper case (driver side)."""
    text = unicodedata.normalize("NFKD", label)
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    return " ".join(text.split()).upper()


# Accented letters and their plain forms.
ACCENTED = "ÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÄËÏÖÇáéíóúüñàèìòùâêîôûäëïöç"
PLAIN = "AEIOUUNAEIOUAEIOUAEIOCaeiouunaeiouaeiouaeioc"


def normalize_text(value: Column) -> Column:
    """Column form of ``normalize_header`` for data values."""
    plain = F.translate(value, ACCENTED, PLAIN)
    return F.upper(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def region_one_hot(region: Column, regions: tuple[str, ...] = REGIONS) -> Column:
    """Indicator array over the region vocabulary; unseen labels count as UNKNOWN."""
    label = F.when(region.isin(list(regions)), region).otherwise(F.lit(UNKNOWN))
    return F.array(*[(label == name).cast("double") for name in regions])


def voltage_scaler(train_nodes: DataFrame) -> DataFrame:
    """One row with the mean and spread of ``ln(kv)`` over distinct training nodes."""
    log_kv = F.ln("kv")
    return train_nodes.select("node", "kv").distinct().agg(
        F.avg(log_kv).alias("log_mean"),
        F.greatest(F.stddev_pop(log_kv), F.lit(1e-6)).alias("log_std"),
    )


def voltage_feature(kv: Column, log_mean: Column, log_std: Column) -> Column:
    return (F.ln(kv) - log_mean) / log_std


def zone_vocabulary(train_nodes: DataFrame) -> DataFrame:
    """``(zone, zone_idx)`` numbered in label order, UNKNOWN being 0.

    The zone dimension has one row per load zone, so its numbering is a small
    ordered window.
    """
    zones = train_nodes.select("zone").where(F.col("zone") != UNKNOWN).distinct()
    numbered = zones.withColumn(
        "zone_idx", F.row_number().over(Window.orderBy("zone")).cast("int")
    )
    unknown = train_nodes.sparkSession.createDataFrame(
        [(UNKNOWN, 0)], "zone string, zone_idx int"
    )
    return numbered.unionByName(unknown)


def encode_zone(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Attach ``zone_idx``; zones outside the vocabulary get 0."""
    return df.join(vocabulary, "zone", "left").withColumn(
        "zone_idx", F.coalesce("zone_idx", F.lit(0)).cast("int")
    )


VERSION_PATTERNS = (r"[Vv](\d{8})", r"[Vv](\d{4})-(\d{2})-(\d{2})")


def parse_version(path: str) -> str | None:
    """Catalogue version ``YYYYMMDD`` from a file name."""
    name = path.rsplit("/", 1)[-1]
    for pattern in VERSION_PATTERNS:
        found = re.search(pattern, name)
        if found:
            return "".join(found.groups())
    return None
