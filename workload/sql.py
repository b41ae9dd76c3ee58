"""SQL building blocks of the result checks, written on the given tables only."""

from __future__ import annotations

from loomgrid.config import SeriesSpec, Settings
from workload.series import (
    HOURLY,
    HOURLY_SETTINGS,
    MONTHLY,
    MONTHLY_SETTINGS,
    WEEKLY,
    WEEKLY_SETTINGS,
)

DAY_NUMBER = "datediff('day', DATE '1970-01-05', CAST(l_shipdate AS DATE))"
OBSERVED = {
    "hourly": """SELECT event_type AS node, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / (count(value) * 100.0::DOUBLE) AS pml FROM events GROUP BY 1, 2""",
    "weekly": f"""SELECT l_returnflag AS node, CAST({DAY_NUMBER} AS BIGINT) AS slot,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / (count(l_extendedprice) * 100.0::DOUBLE) AS pml FROM lineitem GROUP BY 1, 2""",
    "monthly": f"""SELECT n_name AS node, CAST({DAY_NUMBER} // 7 AS BIGINT) AS slot,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / (count(l_extendedprice) * 100.0::DOUBLE) AS pml
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
}
CLOCKS = {
    "hourly": (HOURLY, HOURLY_SETTINGS),
    "weekly": (WEEKLY, WEEKLY_SETTINGS),
    "monthly": (MONTHLY, MONTHLY_SETTINGS),
}
NATIONS = """SELECT n_name AS node, r_name AS region, r_name AS zone,
    (CASE n_nationkey % 3 WHEN 0 THEN 115.0 WHEN 1 THEN 230.0 ELSE 400.0 END)::DOUBLE AS kv
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
CUSTOMERS = """SELECT c_name AS node, c_mktsegment AS name,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'BCA' ELSE 'SIN' END AS sistema,
    r_name AS region, n_name AS zone,
    (CASE c_custkey % 3 WHEN 0 THEN 115.0 WHEN 1 THEN 230.0 ELSE 400.0 END)::DOUBLE AS kv
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""
HOLIDAYS = """SELECT CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1
    HAVING count(*) FILTER (o_orderpriority = '1-URGENT') = 0"""


def clock(name: str) -> tuple[SeriesSpec, Settings]:
    return CLOCKS[name]


def stamp(spec: SeriesSpec, slot: str = "slot") -> str:
    return (
        f"strftime(TIMESTAMP '{spec.anchor} 00:00:00' + to_seconds({slot} * {spec.step_seconds}),"
        " '%Y-%m-%d %H:%M:%S')"
    )


def day_of(spec: SeriesSpec, block: str = "block") -> str:
    return f"(DATE '{spec.anchor}' + CAST({block} * {spec.block_days} AS INTEGER))"


def grid(name: str, max_interp: int | None = None, observed: str | None = None) -> str:
    """CTEs up to ``grid``: the gap-free series with qualities and filled prices."""
    spec, settings = clock(name)
    n = spec.steps_per_block
    m = settings.max_interp if max_interp is None else max_interp
    return f"""obs AS ({observed or OBSERVED[name]}),
    bounds AS (SELECT node, (min(slot) // {n}) * {n} AS lo,
        (max(slot) // {n}) * {n} + {n} - 1 AS hi FROM obs GROUP BY 1),
    cal AS (SELECT node, unnest(generate_series(lo, hi)) AS slot FROM bounds),
    marked AS (SELECT cal.node, cal.slot, o.pml AS v, o.slot AS os
        FROM cal LEFT JOIN obs o ON o.node = cal.node AND o.slot = cal.slot),
    near AS (SELECT *, max(os) OVER (PARTITION BY node ORDER BY slot) AS ps,
        min(os) OVER (PARTITION BY node ORDER BY slot
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ns FROM marked),
    grid AS (SELECT near.node, near.slot, near.slot // {n} AS block,
        near.slot % {n} + 1 AS hora,
        CASE WHEN os IS NOT NULL THEN 'ok' WHEN ns - ps - 1 <= {m} THEN 'interp'
            ELSE 'missing' END AS quality,
        CASE WHEN os IS NOT NULL THEN v WHEN ns - ps - 1 <= {m}
            THEN a.pml + (b.pml - a.pml) * (near.slot - ps) / (ns - ps) END AS pml,
        {day_of(spec, f'(near.slot // {n})')} AS fecha
        FROM near LEFT JOIN obs a ON a.node = near.node AND a.slot = ps
        LEFT JOIN obs b ON b.node = near.node AND b.slot = ns)"""


def stats(name: str, max_interp: int | None = None) -> str:
    """CTEs up to ``stats``: trailing statistics per (node, block)."""
    spec, settings = clock(name)
    n = spec.steps_per_block
    need = settings.min_observations(spec)
    return f"""{grid(name, max_interp)},
    roll AS (SELECT node, block, hora, fecha, count(pml) OVER w AS c,
        CAST(sum(CAST(round(pml * 100000000) AS BIGINT)) OVER w AS BIGINT) / (count(pml) OVER w * 100000000.0::DOUBLE) AS mu,
        stddev_pop(pml) OVER w AS sd,
        CAST(sum(CAST(round(pml * 100000000) AS BIGINT)) OVER r AS BIGINT) / (count(pml) OVER r * 100000000.0::DOUBLE) AS mu_7d
        FROM grid
        WINDOW w AS (PARTITION BY node ORDER BY slot
                ROWS BETWEEN {settings.stats_blocks * n - 1} PRECEDING AND CURRENT ROW),
            r AS (PARTITION BY node ORDER BY slot
                ROWS BETWEEN {settings.input_blocks * n - 1} PRECEDING AND CURRENT ROW)),
    stats AS (SELECT node, block, fecha AS origin, mu_7d, c >= {need} AS valid,
        CASE WHEN c >= {need} THEN mu END AS mu,
        CASE WHEN c >= {need} THEN sd END AS std_raw,
        CASE WHEN c >= {need} THEN c END AS n_obs,
        CASE WHEN c >= {need} THEN greatest(sd, {settings.sigma_floor_rel} * abs(mu),
            {settings.sigma_floor_abs}) END AS sigma
        FROM roll WHERE hora = {n})"""


def origins(name: str, max_interp: int | None = None) -> str:
    """CTEs up to ``origins``: valid origins with their arrays and statistics."""
    spec, settings = clock(name)
    w = settings.input_blocks
    return f"""{stats(name, max_interp)},
    day AS (SELECT node, block, fecha, count(pml) AS n, max(pml) AS top,
        count(*) FILTER (quality = 'missing') AS n_missing,
        count(*) FILTER (quality = 'interp') AS n_interp,
        list(pml ORDER BY hora) AS prices FROM grid GROUP BY 1, 2, 3),
    around AS (SELECT *, count(*) OVER span AS span_n, sum(n_missing) OVER span AS span_m,
        sum(n_interp) OVER (PARTITION BY node ORDER BY block
            ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS n_interp_input,
        lead(n_interp) OVER o AS t_interp, lead(prices) OVER o AS y, lead(top) OVER o AS t_top,
        lag(prices, {settings.week_lag - 1}) OVER o AS week
        FROM day WINDOW o AS (PARTITION BY node ORDER BY block),
            span AS (PARTITION BY node ORDER BY block
                ROWS BETWEEN {w - 1} PRECEDING AND 1 FOLLOWING)),
    origins AS (SELECT a.node, a.block, a.fecha AS origin_date,
        a.fecha + {spec.block_days} AS target_date, a.prices, a.y, a.week,
        CAST(a.n_interp_input AS BIGINT) AS n_interp_input,
        s.mu, s.sigma, s.std_raw, s.mu_7d,
        a.t_top > s.mu + {settings.spike_k} * s.sigma AS is_spike_day
        FROM around a JOIN stats s ON a.node = s.node AND a.block = s.block
        WHERE s.valid AND span_n = {w + 1} AND span_m = 0 AND t_interp = 0
            AND n_interp_input <= {settings.max_interp_input})"""


def labelled(name: str, max_interp: int | None = None) -> str:
    """CTEs up to ``labelled``: origins with their split."""
    _, settings = clock(name)
    return f"""{origins(name, max_interp)},
    last AS (SELECT max(target_date) AS d FROM origins),
    cuts AS (SELECT CAST(d - INTERVAL {settings.test_months} MONTH AS DATE) + 1 AS test_start,
        CAST(d - INTERVAL {settings.test_months} MONTH AS DATE) + 1 - {settings.val_days}
            AS val_start, d AS test_end FROM last),
    labelled AS (SELECT o.*, CASE WHEN target_date >= test_start THEN 'test'
        WHEN target_date >= val_start THEN 'val' ELSE 'train' END AS split
        FROM origins o, cuts)"""


def scored(forecasts: str, n: int, k: int) -> str:
    """CTEs ``hours`` and ``scored`` over ``forecasts(model, id, y, p, ref, ...)``."""
    return f"""forecasts AS ({forecasts}),
    hours AS (SELECT model, id, hora, y[hora] AS y, p[hora] AS p, ref[hora] AS ref,
        row_number() OVER (PARTITION BY model, id ORDER BY y[hora] DESC, hora) AS ry,
        row_number() OVER (PARTITION BY model, id ORDER BY p[hora] DESC, hora) AS rp
        FROM (SELECT *, unnest(range(1, {n + 1})) AS hora FROM forecasts)),
    parts AS (SELECT model, id, sum(abs(p - y)) AS abs_sum, sum((p - y) * (p - y)) AS sq_sum,
        sum(CASE WHEN abs(y) + abs(p) < 1e-6 THEN 0 ELSE 2 * abs(p - y) / (abs(y) + abs(p)) END)
            AS smape_sum, sum(abs(ref - y)) AS ref_sum,
        count(*) FILTER (ry <= {k} AND rp <= {k}) / {float(k)} AS overlap,
        CASE WHEN sum(y) FILTER (ry <= {k}) > 0
            THEN sum(y) FILTER (rp <= {k}) / sum(y) FILTER (ry <= {k}) END AS captured
        FROM hours GROUP BY 1, 2),
    scored AS (SELECT f.*, abs_sum, sq_sum, smape_sum, ref_sum, overlap, captured
        FROM forecasts f JOIN parts USING (model, id))"""


def measures(n: int) -> str:
    return f"""round(sum(abs_sum) / (count(*) * {n}), 6) AS mae,
    round(sqrt(sum(sq_sum) / (count(*) * {n})), 6) AS rmse,
    round(100 * sum(smape_sum) / (count(*) * {n}), 6) AS smape,
    round(CASE WHEN sum(ref_sum) > 0 THEN 1 - sum(abs_sum) / sum(ref_sum) END, 6) AS skill,
    round(avg(overlap), 6) AS top4_overlap, round(avg(captured), 6) AS captured_value,
    count(*) AS n_samples"""
