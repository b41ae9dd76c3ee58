"""Bottom-k sketches of word shingles. DataFrame operations only.

A sketch is the sorted array of the k smallest 64-bit hashes of a text's distinct shingles of
five words (a shorter text is one shingle, a text without words has an empty sketch). Sketches of
parts merge to the sketch of the whole, so a collection can be sketched by partial aggregation.
Resemblance, containment and the number of distinct shingles are estimated from sketches alone,
with a standard error of about ``sqrt(j * (1 - j) / k)``; below k shingles they are exact.

Defined results: a null text counts as empty; two empty sketches resemble each other fully, an
empty and another one not at all; an empty sketch is contained in everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.rows import words
from loomgrid.operators.numbering import range_part
from loomgrid.session import stage

K = 128
SHINGLE = 5
SPAN = float(2**64)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of column ``text`` as column ``name``."""
    hashes = f"_{name}_words"
    df = df.withColumn(hashes, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    size = F.size(hashes)
    starts = F.sequence(F.lit(1), size - (width - 1))
    shingles = (
        F.when(size >= width, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, width))))
        .when(size > 0, F.array(F.xxhash64(F.col(hashes))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return df.withColumn(name, smallest(F.array_distinct(shingles), k)).drop(hashes)


def smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return smallest(F.array_union(a, b), k)


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group. Only k values of a group matter, and ranks are taken in two steps:
    within a part of the group first, so that a hot group spreads over tasks."""
    values = df.select(*keys, F.explode(sketch).alias("h")).distinct()
    parts = [*keys, F.pmod(F.col("h"), F.lit(64)).alias("part")]
    ranked = values.select("*", parts[-1]).withColumn(
        "r", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("h"))
    )
    kept = ranked.where(F.col("r") <= k).groupBy(*keys)
    return kept.agg(smallest(F.collect_list("h"), k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of two texts."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(sketch, -1).cast("double") + SPAN / 2) / SPAN
    many = F.when(F.size(sketch) >= k, (k - 1) / share)
    return F.coalesce(many, F.size(sketch).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second one has too."""
    union = distinct_shingles(merge(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def as_text(sketch: Column) -> Column:
    """Sketch as a string: its hashes in hexadecimal, one after the other."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ".")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document with its text half replaced by the beginning of the next document.

    Texts are shuffled once, into ranges of the id of about equal rows; only the last row of a
    range looks up the first text of the following one, of which there is one per range. Rows
    are ordered by id, then text: those without id come first, those with equal ids follow
    each other.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", range_part(rows, "id", parts))
    # null ids sort first, so a part that has any begins with them
    head = F.when(F.count("id") == F.count("*"), F.min("id")).alias("head")
    # written, so that Spark broadcasts it on its size and shuffles no text to find a few
    heads = stage(rows.groupBy("part").agg(head), "heads")
    texts = rows.join(heads.withColumnRenamed("part", "at"), F.col("id").eqNullSafe(F.col("head")))
    heads = texts.groupBy("at").agg(F.min("text").alias("first"))
    # one row per range
    line = Window.partitionBy(F.lit(0))
    after = F.coalesce(F.lead("first").over(line.orderBy("at")), F.first("first").over(line.orderBy("at")))
    heads = heads.select(F.col("at").alias("part"), after.alias("after"))
    follows = F.lead("text").over(Window.partitionBy("part").orderBy("id", "text"))
    found = rows.withColumn("follows", follows).join(heads, "part", "left")
    next_text = F.coalesce("follows", "after")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return found.select(
        "id",
        "text",
        n.cast("bigint").alias("n_chars"),
        F.concat(F.left("text", n - half), F.left(next_text, half)).alias("edited"),
        next_text.alias("next_text"),
    )


def fingerprint_report(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses."""
    df = edited_neighbours(docs)
    for text, name in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        df = with_sketch(df, text, name, k)
    return df.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("following"), k).alias("near_next"),
        F.round(distinct_shingles(F.col("own"), k)).cast("bigint").alias("n_shingles"),
        containment(F.col("own"), F.col("changed"), k).alias("kept_share"),
    )
