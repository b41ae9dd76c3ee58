"""Connected components of a table of links, in rounds of two star steps.

Each round links every node's larger neighbours to its smallest one, then every node's smaller
neighbours to the smallest of them; the number of rounds grows with the logarithm of the longest
path. Rounds are cut by written tables. The smallest neighbour of a node is found by partial
aggregation and written before it is joined back, so both sides of that join are plain tables:
the side that holds a hub's links can be split by adaptive execution, or the other one broadcast
where its written size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.session import stage


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links (u, v)``; the root is the smallest node reachable.

    Roots themselves are left out, as are links of a node to itself or with a null end. Repeated
    links and links given both ways make no difference; no link gives an empty table.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = stage(links.where("u <> v").distinct(), "links")
    seen = state(links)
    while True:
        links = stage(small_star(large_star(links)), "links")
        found = state(links)
        if found == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def large_star(links: DataFrame) -> DataFrame:
    """Links of every node's larger neighbours to the smallest of it and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    low = stage(low, "low")
    up = both.where("v > u").join(low, "u")
    return stage(up.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "large")


def small_star(links: DataFrame) -> DataFrame:
    """Links of every node and its smaller neighbours to the smallest of these."""
    low = stage(links.groupBy("u").agg(F.min("v").alias("low")), "low")
    moved = links.join(low, "u").where("v <> low").select(F.col("v").alias("u"), "low")
    return moved.union(low).distinct().select("u", F.col("low").alias("v"))
