"""Boilerplate lines by their frequency within a site. DataFrame operations only.

A line is boilerplate on a host when it stands on more than ``ratio`` of the host's pages, and
on ``min_pages`` of them at least. A host has few such lines, whatever its size: the pages of
all lines together are the pages times the mean number of lines, so at most (mean distinct lines
of a page) / ratio lines can pass. That list is therefore kept as one array per host and joined
to the pages, and page texts are never shuffled while the lists stay below the broadcast
threshold that Spark checks against their written size; beyond it they are joined by a shuffle
whose hot hosts adaptive execution splits.

Defined results: a page without text or without host is returned as it is; pages without text
count as pages of their host; blank lines are never counted or dropped; a line that a page repeats
counts once; every copy of a boilerplate line goes; repeated rows count as so many pages, or with
``copies_once`` all pages of a host with equal texts as one; a text all of whose lines go becomes empty. Lines are compared without the white space at their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.rows import WHITESPACE, unwrap, wrap
from loomgrid.session import stage

RATIO = 0.1
MIN_PAGES = 3


def url_host(url: Column) -> Column:
    """Host of an address, in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITESPACE))


def line_key(line: Column) -> Column:
    """128 bits that stand for a line: two hashes with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(
    pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False
) -> DataFrame:
    """(host, dropped): the keys of each host's boilerplate lines, of ``pages (host, text)``."""
    lines = F.array_distinct(F.transform(F.split("text", "\n"), bare))
    keys = F.transform(F.filter(lines, lambda x: x != ""), line_key)
    pages = pages.where(F.col("host").isNotNull()).select("host", line_key(F.col("text")).alias("page"), keys.alias("keys"))
    if copies_once:
        # copies meet before the shuffle, and only keys of lines are shuffled
        pages = pages.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    counts = (
        pages.select("host", F.explode("keys").alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return (
        counts.join(totals, "host")
        .where(F.col("n") > F.col("total") * F.lit(float(ratio)))
        .groupBy("host")
        .agg(F.collect_list("key").alias("dropped"))
    )


def dedup_lines(
    df: DataFrame,
    host: Column | str,
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """``df`` with ``text`` freed of boilerplate lines, ``n_lines`` before and ``n_dropped``."""
    pages = wrap(df, host=host, text=text)
    lists = stage(boilerplate(pages.select("host", "text"), ratio, min_pages, copies_once), "boilerplate")
    found = pages.join(lists, "host", "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("dropped"), line_key(bare(x))))
    found = found.withColumn("kept", F.when(F.col("dropped").isNotNull(), kept))
    cut = F.coalesce(F.size(lines) - F.size("kept"), F.lit(0))
    return unwrap(
        found,
        **{
            text: F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")),
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"),
            "n_dropped": cut.cast("bigint"),
        },
    )
