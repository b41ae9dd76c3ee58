"""The pipeline's stages, each against what it may drop, and the queries with SQL."""

import itertools

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from loomgrid.llm import simhash
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"


def one_of_each_group(docs):
    """Smallest ids of the groups that links of fingerprints and five-word Jaccard of 0.8 make, by brute force."""
    rows = docs.where("doc_id is not null").select("doc_id", "text").collect()
    label = {r["doc_id"]: r["component_id"] for r in simhash.component_table(docs).collect()}
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    for i, j in itertools.combinations(sorted(sets), 2):
        either = sets[i] | sets[j]
        if label[i] != label[j] and (len(sets[i] & sets[j]) / len(either) if either else 1) >= 0.8:
            low, high = sorted((label[i], label[j]))
            label = {k: low if x == high else x for k, x in label.items()}
    return {min(k for k in sets if label[k] == x) for x in set(label[k] for k in sets)}


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_stages_work_on_what_their_predecessors_kept(spark):
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (None, "x", "en", "src1", 1)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    kept = [ids]
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = step(spark, docs, SF).cache()
        assert docs.columns == columns, name
        kept.append({r[0] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "simhash_near_dedup":
            assert kept[-1] - {None} == one_of_each_group(before)
    assert len(kept[1]) < len(kept[0]) and len(kept[1]) > 0.8 * len(ids)
    assert 10**6 not in kept[2] and 10**6 + 1 not in kept[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed["doc_id"].dropna()) == kept[-1] - {None}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_warc", "op11_merkle_manifest", "op12_spelling_variants"])
def test_query_equals_its_sql(spark, name):
    outcome, _, _ = compare(spark, connect(SF), name, SF, contract.queries(), contract.oracle_sql())
    assert outcome == "ok"


def test_all_are_registered():
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier",
        "language_id",
        "line_dedup",
        "simhash_near_dedup",
        "best_fit_packing",
    ]


def test_copies_that_fill_a_third_of_a_source_keep_their_text(spark):
    plain = [f"only line {i} of its page, {i * 7} words\nand a second one {i}" for i in range(20)]
    copied = "a clean document\nthat was copied often"
    rows = [(i, copied if i % 3 == 0 else plain[i % 20], "en", "src1", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES[2:-1]:
        docs = step(spark, docs, SF).cache()
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found[0] == copied and "" not in found.values()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("doc_id = 0 and length > 0").count() == 1


def test_lines_on_a_few_per_cent_of_a_source_go(spark):
    rows = [(i, f"page {i}\nnotice\nend {i}" if i < 4 else f"page {i}", "en", "src1", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, SF).collect()}
    assert found == {i: f"page {i}\nend {i}" if i < 4 else f"page {i}" for i in range(100)}
