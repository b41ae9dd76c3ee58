"""Carrying a caller's rows through an operator whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"
WHITESPACE = " \t\n\x0b\x0c\r"
BLANKS = "[ \\t-\\r]+"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def wrap(df: DataFrame, **named: Column | str) -> DataFrame:
    """The whole row as one struct beside the named inputs, so that no name can clash."""
    inputs = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()]
    return df.select(F.struct("*").alias(ROW), *inputs)


def unwrap(df: DataFrame, **added: Column | str) -> DataFrame:
    """The caller's columns, with the added ones in place of columns of the same name."""
    mine = {n.lower() for n in added}
    kept = [
        F.col(ROW)[f.name].alias(f.name)
        for f in df.schema[ROW].dataType.fields
        if f.name.lower() not in mine
    ]
    new = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in added.items()]
    return df.select(*kept, *new)


def words(text: Column) -> Column:
    """Words between ASCII white space; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))
