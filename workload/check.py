"""Compare queries with their SQL on one folder: python -m workload.check DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from loomgrid.session import local_session
from workload.oracles import ORACLES
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v) for v in row)


def compare(
    spark, con, name: str, sf_dir: str, queries: dict = QUERIES, oracles: dict = ORACLES
) -> tuple[str, int, float]:
    """Outcome, row count and Spark seconds of one query."""
    started = time.monotonic()
    df = queries[name](spark, sf_dir)
    columns = sorted(df.columns)
    left = [tuple(r) for r in df.select(*columns).collect()]
    seconds = time.monotonic() - started
    if name not in oracles:
        return ("rows only" if left else "EMPTY"), len(left), seconds
    relation = con.sql(oracles[name])
    if sorted(relation.columns) != columns:
        return f"COLUMNS {columns} vs {sorted(relation.columns)}", len(left), seconds
    right = con.sql(
        "SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({oracles[name]})"
    ).fetchall()
    if len(left) != len(right):
        return f"ROWS {len(left)} vs {len(right)}", len(left), seconds
    kinds = dict(df.dtypes)
    for a, b in zip(sorted(left, key=_key), sorted(right, key=_key)):
        for c, x, y in zip(columns, a, b):
            same = x == y or (
                kinds[c] == "double"
                and x is not None
                and y is not None
                and math.isnan(x)
                and math.isnan(y)
            )
            if not same:
                return f"VALUE {c}: {x!r} vs {y!r} in {a} vs {b}", len(left), seconds
    return ("ok" if left else "EMPTY"), len(left), seconds


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            outcome, rows, seconds = compare(spark, con, name, sf_dir)
        except Exception as error:  # report every query, whatever the failure
            outcome, rows, seconds = f"ERROR {str(error)[:600]}", -1, 0.0
        bad += outcome not in ("ok", "rows only")
        print(f"CHECK {name:26s} {rows:8d} {seconds:7.2f}s {outcome}", flush=True)
    print(f"CHECK {len(names)} queries, {bad} not right")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
