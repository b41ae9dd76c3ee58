import datetime
import math
import os
import sys
import zoneinfo

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomgrid.config import TIME_ZONE, SeriesSpec  # noqa: E402
from loomgrid.operators import cleaning, grid  # noqa: E402
from loomgrid.schemas import SILVER  # noqa: E402
from loomgrid.session import local_session  # noqa: E402

HOURLY = SeriesSpec()


def local_hours(day):
    """Hours of a local day, by the zone rules of the standard library."""
    zone = zoneinfo.ZoneInfo(TIME_ZONE)
    ends = [datetime.datetime.combine(day + datetime.timedelta(n), datetime.time(), zone) for n in (0, 1)]
    return round((ends[1].timestamp() - ends[0].timestamp()) / 3600)


def days_of(first_year, last_year):
    day = datetime.date(first_year, 1, 1)
    while day.year <= last_year:
        yield day
        day += datetime.timedelta(days=1)


SHORT_DAY = next(d for d in days_of(2022, 2022) if local_hours(d) == 23)
LONG_DAY = next(d for d in days_of(2021, 2021) if local_hours(d) == 25)


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


def price_days(node, start, days, holes=(), base=400.0, seed=0):
    """Records of one node: two daily humps, a weekly swing and noise; no record in a hole."""
    noise = np.random.default_rng([seed, 17]).uniform(-12.0, 12.0, (days, 25))
    out = []
    for i in range(days):
        day = start + datetime.timedelta(days=i)
        swing = 40.0 * math.sin(2 * math.pi * day.weekday() / 7)
        for hora in range(1, local_hours(day) + 1):
            if (day, hora) not in holes:
                hump = 90.0 * math.sin(math.pi * hora / 6) ** 2
                price = base + swing + hump + float(noise[i, hora - 1])
                out.append((node, day, hora, price, price - 30.0, 20.0, 10.0))
    return out


RECORD_COLUMNS = "node string, fecha date, hora int, pml double, pml_ene double, pml_per double, pml_cng double"


def records_frame(spark, rows):
    return spark.createDataFrame(rows, RECORD_COLUMNS).selectExpr("*", "0 AS arrival")


def hourly_rows(spark, rows, spec=HOURLY):
    return cleaning.records_to_hourly(records_frame(spark, rows), spec, ["arrival"])


def silver_from_days(spark, qualities, prices=None, node="N1", start=datetime.date(2024, 1, 1)):
    """Silver grid of whole days with the given quality lists (24 per day)."""
    rows = []
    for i, day_quality in enumerate(qualities):
        day = start + datetime.timedelta(days=i)
        for h in range(24):
            q = day_quality[h]
            p = None if q == "missing" else (prices[i][h] if prices is not None else 100.0 + h)
            ts = datetime.datetime.combine(day, datetime.time(h))
            rows.append((node, "MDA", "SIN", ts, day, h + 1, p, p, p, p, q, h + 1, None))
    return spark.createDataFrame(rows, SILVER)


def from_pandas(spark, frame, folder):
    """Silver rows through a Parquet file (keeps local timestamps without a zone)."""
    frame = frame.copy()
    frame["ts_local"] = frame["ts_local"].astype("datetime64[us]")
    frame["source_hora"] = frame["source_hora"].astype("Int32")
    frame["ingested_at"] = pd.Series(pd.NaT, index=frame.index, dtype="datetime64[us, UTC]")
    path = f"{folder}/rows.parquet"
    frame.to_parquet(path, index=False)
    return spark.read.schema(SILVER).parquet(path)


def hours_from(day, first, count):
    """(day, hora) of so many normal hours from the first one on."""
    at = datetime.datetime.combine(day, datetime.time(first - 1))
    steps = (at + datetime.timedelta(hours=k) for k in range(count))
    return {(t.date(), t.hour + 1) for t in steps}


@pytest.fixture(scope="session")
def three_series(spark):
    """Three nodes over 236 days with both kinds of transition; one has a short and a long gap."""
    start = datetime.date(2021, 10, 4)
    holes = hours_from(datetime.date(2021, 12, 7), 9, 3) | hours_from(datetime.date(2022, 1, 20), 12, 26)
    rows = price_days("SUN-3", start, 236, holes, seed=5)
    rows += price_days("KITE-2", start, 236, base=520.0, seed=6)
    rows += price_days("DAM-1", start, 236, base=610.0, seed=7)
    built = grid.build_grid(hourly_rows(spark, rows), HOURLY)
    return built.cache()


@pytest.fixture(scope="session")
def three_nodes(spark):
    rows = [
        ("SUN-3", "SIN", "ORIENTAL", "NORTHSHORE", 115.0),
        ("KITE-2", "SIN", "ORIENTAL", "NORTHSHORE", 230.0),
        ("DAM-1", "SIN", "ORIENTAL", "BAYSIDE", 400.0),
    ]
    return spark.createDataFrame(
        rows, "node string, sistema string, region string, zone string, kv double"
    )
