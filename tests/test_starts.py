import datetime

import pytest
from conftest import HOURLY
from pyspark.sql import functions as F

from loomgrid.config import Settings
from loomgrid.plans import dataset, selection

SETTINGS = Settings(test_months=1, val_days=14, input_blocks=3, stats_blocks=14)


def test_training_starts_equal_datasets_built_from_them(spark, three_series, three_nodes):
    """The last start cuts windows of validation samples, two lie so near that their heads overlap."""
    holidays = spark.sql("SELECT date'2022-03-21' AS date UNION ALL SELECT date'2022-05-05'")
    ds = dataset.build_dataset(three_series, three_nodes, "all", HOURLY, SETTINGS, holidays=holidays, sequences=False)
    end = ds.samples.agg(F.max("target_date")).first()[0]
    early, starts = datetime.date(2019, 1, 1), [datetime.date(2022, 3, 1), datetime.date(2022, 3, 8), datetime.date(2022, 3, 29)]
    found = selection.training_window(three_series, ds, three_nodes, holidays, [early, *starts, starts[0]])
    found = {r["start"]: r.asDict() for r in found.collect()}
    assert set(found) == {s.isoformat() for s in starts}
    for start in starts:
        built = dataset.build_dataset(
            three_series, three_nodes, "from", HOURLY, SETTINGS, start=start, end=end, holidays=holidays, sequences=False
        )
        val, test = selection._evaluate_ridge(built)
        test, row = test.first(), found[start.isoformat()]
        assert row["n_train"] == built.samples.where("split = 'train'").count()
        assert row["train_years"] == round((end - start).days / 365.25, 1)
        assert row["val_mae"] == pytest.approx(val, rel=1e-7)
        assert row["test_mae"] == pytest.approx(test["mae"], rel=1e-7)
        assert row["test_skill"] == pytest.approx(test["skill"], rel=1e-6)
        assert row["test_top4"] == pytest.approx(test["top4_overlap"])
    with pytest.raises(ValueError):
        selection.training_window(three_series, ds, three_nodes, holidays, [early])
