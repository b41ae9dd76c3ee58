"""Line dedup and fingerprints against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import fingerprints, line_dedup

DOCS = "doc_id long, text string, source string, host string, n_lines int"


def brute_lines(rows, ratio, least):
    pages, counts = Counter(), defaultdict(Counter)
    for _, text, host, *_ in rows:
        if host is not None:
            pages[host] += 1
            counts[host].update({x.strip() for x in (text or "").split("\n")} - {""})
    out = []
    for doc_id, text, host, *_ in rows:
        lines = text.split("\n") if text is not None else []
        gone = [
            host is not None and counts[host][x.strip()] >= least and counts[host][x.strip()] > ratio * pages[host]
            for x in lines
        ]
        kept = None if text is None else "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc_id, kept, len(lines), sum(gone)))
    return out


@pytest.mark.parametrize("ratio,least", [(0.3, 3), (0.1, 2), (0.9, 1)])
def test_lines_match_brute_force(spark, ratio, least):
    draw = random.Random(3)
    lines = ["menu", " menu ", "", "a b", "\tfooter\r", *[f"line {i}" for i in range(30)]]
    rows = []
    for i in range(60):
        text = "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 6)))
        host = draw.choice(["x.org", "x.org", "y.net", None])
        rows.append((i // 2, None if i % 13 == 0 else text, host, "clash", i))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), "source", ratio=ratio, min_pages=least)
    assert got.columns == ["doc_id", "source", "host", "text", "n_lines", "n_dropped"]
    found = [tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(found, key=str) == sorted(brute_lines(rows, ratio, least), key=str)


def test_lines_of_an_empty_table_and_url_hosts(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS), "source").count() == 0
    urls = spark.createDataFrame([("https://A.Org/x",), ("no url",), (None,)], "u string")
    assert [r[0] for r in urls.select(line_dedup.url_host(F.col("u"))).collect()] == ["a.org", None, None]


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_match_sets_where_sketches_hold_all(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdef") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    texts += ["", None, "one", "é ü 漢 字 𝄞 x", texts[0], "w " * 3000]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(shingles(text), shingles(edited)))
        assert r["near_next"] == pytest.approx(jaccard(shingles(text), shingles(following)))
        assert r["n_shingles"] == len(shingles(text))
    assert got[0]["fingerprint"] == got[3 * texts.index(texts[0], 1)]["fingerprint"]


def test_fingerprints_of_ties_null_ids_and_nothing(spark):
    rows = [(None, "n"), (1, "b"), (1, "a"), (1, "a"), (2, None)]
    got = fingerprints.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["id"]), r["text"], r["next_text"]) for r in got) == [
        ("1", "a", "a"), ("1", "a", "b"), ("1", "b", ""), ("2", "", "n"), ("None", "n", "a"),
    ]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.fingerprint_report(empty).count() == 0


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = [(0, " ".join(words[:3000])), (1, " ".join(words[1000:]))]
    df = fingerprints.with_sketch(spark.createDataFrame(rows, "g long, text string"), "text", "sketch")
    merged = fingerprints.merge_groups(df.withColumn("all", F.lit(1)), ["all"], "sketch")
    whole = fingerprints.with_sketch(spark.createDataFrame([(" ".join(words),)], "text string"), "text", "s")
    assert set(merged.first()["sketch"]) == set(whole.first()["s"])  # windows of the whole are in one part
    pair = df.where("g = 0").select(F.col("sketch").alias("a")).crossJoin(df.where("g = 1").select(F.col("sketch").alias("b")))
    r = pair.select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"),
        fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
        fingerprints.distinct_shingles(F.col("a")).alias("n"),
    ).first()
    assert abs(r["j"] - 0.5) < 0.15 and abs(r["c"] - 2 / 3) < 0.2 and abs(r["n"] / 2996 - 1) < 0.3
