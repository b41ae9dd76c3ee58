import math

import pytest

import __spark_entry__ as contract
from workload.check import compare, connect
from workload.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"


def test_entry_returns_the_headline_table(spark):
    rows = contract.entry(spark).collect()
    assert {r["model_name"] for r in rows} == {"naive24", "naive168"}
    assert all(math.isfinite(r["mae"]) and r["n_samples"] > 100 for r in rows)


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 90


# the smallest tables hold no case of these
EMPTY = (
    "daylight_saving_rows",
    "coverage_pairs",
    "valid_origins",
    "samples_long",
    "target_prices",
    "daily_score_pending",
)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    outcome, _, _ = compare(spark, connect(SMALL), name, SMALL)
    assert outcome == ("EMPTY" if name in EMPTY else "ok")
