"""The same results in plain SQL over the given tables."""

from __future__ import annotations

from loomgrid.config import SeriesSpec
from loomgrid.operators.forecasters import RIDGE_ALPHAS
from workload import sql
from workload.queries import PLAN, PLAN_EPOCH
from workload.sql import clock, day_of, grid, labelled, measures, origins, scored, stamp, stats

HOUR, HOUR_SET = clock("hourly")
WEEK, WEEK_SET = clock("weekly")
MONTH, MONTH_SET = clock("monthly")

# Daylight-saving days of the zone within the shipment dates.
SPRING = ("1996-04-07", "1997-04-06", "1998-04-05", "1999-04-04", "2000-04-02", "2001-05-06")
FALL = ("1996-10-27", "1997-10-26", "1998-10-25", "1999-10-31", "2000-10-29", "2001-09-30")


def dates(days: tuple[str, ...]) -> str:
    return ", ".join(f"DATE '{d}'" for d in days)


def derived_runs(name: str, max_interp: int | None = None) -> str:
    spec, _ = clock(name)
    return f"""{grid(name, max_interp)},
    derived AS (SELECT node, slot, quality,
        slot - row_number() OVER (PARTITION BY node ORDER BY slot) AS run
        FROM grid WHERE quality IN ('interp', 'missing')),
    runs AS (SELECT node, min(slot) AS lo, max(slot) AS hi, count(*) AS n_hours,
        arg_min(quality, slot) AS kind FROM derived GROUP BY node, run)"""


ALIGN = f"""items AS (SELECT CAST(l_shipdate AS DATE) AS fecha, l_orderkey + 5 * l_linenumber AS s,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
        CAST(l_quantity AS BIGINT) % 8 AS more FROM lineitem),
    spread AS (SELECT fecha, cents, unnest(range(s, s + more + 1)) %
        CASE WHEN fecha IN ({dates(SPRING)}) THEN 23 WHEN fecha IN ({dates(FALL)}) THEN 25
        ELSE 24 END + 1 AS hora FROM items),
    numbered AS (SELECT fecha, hora, CAST(sum(cents) AS BIGINT) / count(*) / 100 AS pml
        FROM spread GROUP BY 1, 2),
    kinds AS (SELECT *, CASE WHEN fecha IN ({dates(SPRING)}) THEN 'spring'
        WHEN fecha IN ({dates(FALL)}) THEN 'fall' ELSE 'normal' END AS kind FROM numbered),
    records AS (SELECT *, count(*) OVER (PARTITION BY fecha) AS c FROM kinds
        WHERE hora <= CASE kind WHEN 'spring' THEN 23 WHEN 'fall' THEN 25 ELSE 24 END),
    typed AS (SELECT fecha, hora, pml, kind = 'spring' AND c = 23 AS short,
        kind = 'fall' AND c = 25 AS long FROM records),
    aligned AS (
        SELECT fecha, CASE WHEN short AND hora >= 3 THEN hora + 1
                WHEN long AND hora >= 4 THEN hora - 1 ELSE hora END AS hora,
            pml, 'ok' AS quality, hora AS source_hora
            FROM typed WHERE NOT (long AND hora IN (2, 3)) AND (hora <= 24 OR long)
        UNION ALL SELECT fecha, 3, avg(pml), 'dst_fill', NULL
            FROM typed WHERE short AND hora IN (2, 3) GROUP BY 1
        UNION ALL SELECT fecha, 2, avg(pml), 'dst_merge', 2
            FROM typed WHERE long AND hora IN (2, 3) GROUP BY 1)"""

MERGE_OBS = """SELECT node, slot, arg_min(pml, pri) AS pml FROM (
        SELECT event_type AS node, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot,
            CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / count(value) / 100 AS pml, 0 AS pri FROM events
            WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2
        UNION ALL SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT), max(value), 1
            FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2) GROUP BY 1, 2"""

NAIVES = """SELECT 'naive24' AS model, node || '|' || block AS id, node, block, origin_date,
    target_date, is_spike_day, split, y, prices AS p, week AS ref FROM labelled
    UNION ALL SELECT 'naive168', node || '|' || block, node, block, origin_date,
    target_date, is_spike_day, split, y, week, week FROM labelled"""
TEST_NAIVES = f"SELECT * FROM ({NAIVES}) WHERE split = 'test'"
REGION_NAIVES = f"SELECT x.*, c.region, c.zone FROM ({NAIVES}) x JOIN ({sql.NATIONS}) c USING (node)"

WEEK_TEST = f"WITH {labelled('weekly')}, {scored(TEST_NAIVES, 7, WEEK_SET.top_k)}"
WEEK_ALL = f"WITH {labelled('weekly')}, {scored(NAIVES, 7, WEEK_SET.top_k)}"
MONTH_ALL = f"WITH {labelled('monthly')}, {scored(REGION_NAIVES, 4, MONTH_SET.top_k)}"
ZONE_TEST = (
    f"WITH {labelled('monthly')}, "
    + scored(f"SELECT * FROM ({REGION_NAIVES}) WHERE split = 'test'", 4, MONTH_SET.top_k)
)


def steps(name: str, keys: str, where: str = "true", **arrays: str) -> str:
    n = clock(name)[0].steps_per_block
    picks = ", ".join(f"round({a}[hora], 6) AS {c}" for c, a in arrays.items())
    return f"""WITH {labelled(name)}
    SELECT {keys}, hora, {picks}
    FROM (SELECT *, unnest(range(1, {n + 1})) AS hora FROM labelled WHERE {where})"""


MONTH_NODES = f"""{labelled('monthly')}, cat AS ({sql.NATIONS}),
    tagged AS (SELECT l.*, c.region, c.zone, c.kv FROM labelled l JOIN cat c USING (node)),
    train AS (SELECT DISTINCT node, zone, kv FROM tagged WHERE split = 'train')"""

SELECTED = f"""cust AS ({sql.CUSTOMERS}),
    elig AS (SELECT * FROM cust WHERE sistema = 'SIN'),
    l400 AS (SELECT node, zone FROM elig WHERE kv = 400),
    z400 AS (SELECT zone, count(*) AS n FROM l400 GROUP BY 1),
    p230 AS (SELECT e.node, e.region, e.zone, coalesce(z.n, 0) + row_number() OVER
        (PARTITION BY e.zone ORDER BY e.node) - 1 AS zc
        FROM elig e LEFT JOIN z400 z ON z.zone = e.zone WHERE kv = 230),
    r230 AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY zc, node) AS r FROM p230),
    l230 AS (SELECT node, zone FROM r230 ORDER BY r, zc, node LIMIT 60),
    z230 AS (SELECT zone, count(*) AS n FROM (FROM l400 UNION ALL FROM l230) GROUP BY 1),
    p115 AS (SELECT e.node, e.region, e.zone, coalesce(z.n, 0) + row_number() OVER
        (PARTITION BY e.zone ORDER BY e.node) - 1 AS zc
        FROM elig e LEFT JOIN z230 z ON z.zone = e.zone WHERE kv = 115),
    r115 AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY zc, node) AS r FROM p115),
    l115 AS (SELECT node, zone FROM r115 ORDER BY r, zc, node LIMIT 30),
    selected AS (SELECT c.* FROM cust c WHERE node IN (SELECT node FROM l400
        UNION ALL SELECT node FROM l230 UNION ALL SELECT node FROM l115))"""

REQUESTS = """SELECT o_orderkey,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'XXX' ELSE 'SIN' END AS sistema,
    CASE WHEN o_orderstatus = 'P' THEN '???' ELSE 'MDA' END AS proceso,
    [c_mktsegment, 'N' || c_nationkey] AS nodes, CAST(o_orderdate AS DATE) AS s,
    CAST(o_orderdate AS DATE) + CAST(left(o_orderpriority, 1) AS INTEGER) * 2 - 3 AS e
    FROM orders JOIN customer ON o_custkey = c_custkey"""
PAIRS = f"""SELECT DISTINCT unnest(nodes) AS node, CAST(d AS DATE) AS fecha FROM (
    SELECT nodes, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d
    FROM ({REQUESTS}) WHERE e >= s)"""
NATION_DAYS = """SELECT DISTINCT n_name AS node, CAST(l_shipdate AS DATE) AS fecha
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey"""
CALENDAR_HOLIDAYS = """SELECT CAST(ts AS DATE) AS d FROM events GROUP BY 1
    HAVING count(*) FILTER (event_type = 'error') * 5 > count(*)"""

# orders seen as service responses
RESPONSES = """SELECT o_orderkey, o_custkey, o_orderstatus, left(o_orderpriority, 1) AS pr,
    CASE WHEN o_totalprice < 50000 THEN 503 WHEN o_totalprice < 60000 THEN 404 ELSE 200 END
    AS status, o_orderstatus <> 'P' AND left(o_orderpriority, 1) IN ('1', '2', '3') AS has_data
    FROM orders"""

# stored forecasts are the lagged block, a tenth higher
FORECASTS = f"""{labelled('weekly')},
    fc AS (SELECT node, block, target_date, list_transform(week, lambda v: v * 1.1) AS p,
        y, prices, week FROM labelled)"""
SCORES = f"""WITH {FORECASTS}, {scored(
    "SELECT 'm' AS model, node || '|' || block AS id, node, target_date, y, p, week AS ref, prices "
    "FROM fc", 7, WEEK_SET.top_k)},
    naive AS (SELECT model, id, avg(abs(prices[hora] - y[hora])) AS n24
        FROM (SELECT *, unnest(range(1, 8)) AS hora FROM forecasts) GROUP BY 1, 2),
    scores AS (SELECT node, target_date, abs_sum / 7 AS mae, sqrt(sq_sum / 7) AS rmse,
        overlap AS top4_overlap, captured AS captured_value, n24 AS naive24_mae,
        ref_sum / 7 AS naive168_mae,
        CASE WHEN n24 > 0 THEN 1 - abs_sum / 7 / n24 END AS skill_vs_naive24
        FROM scored JOIN naive USING (model, id))"""


def rounded(*columns: str) -> str:
    """Halves are rounded up, as numbers of ten decimals show them."""
    return ", ".join(f"CAST(round(CAST({c} AS DECIMAL(28, 10)), 6) AS DOUBLE) AS {c}" for c in columns)


SEASONAL = f"""WITH {labelled('weekly')},
    cutoff AS (SELECT max(target_date) AS d FROM labelled WHERE split IN ('train', 'val')),
    hist AS (SELECT node, fecha, prices, list_avg(prices) AS level FROM day, cutoff
        WHERE fecha <= d AND fecha > CAST(d - INTERVAL 24 MONTH AS DATE) AND n = 7),
    keyed AS (SELECT *, dayofyear(fecha) AS doy, isodow(fecha) - 1 AS dow,
        (month(fecha) % 12) // 3 AS season FROM hist),
    shapes AS (SELECT node, dow, season, hora, avg(prices[hora] / level) AS ratio
        FROM (SELECT *, unnest(range(1, 8)) AS hora FROM keyed WHERE abs(level) >= 10)
        GROUP BY ALL),
    overall AS (SELECT node, avg(level) AS level FROM keyed GROUP BY 1),
    targets AS (SELECT node, target_date, dayofyear(target_date) AS doy,
        isodow(target_date) - 1 AS dow, (month(target_date) % 12) // 3 AS season
        FROM labelled WHERE split = 'test'),
    levels AS (SELECT t.node, t.target_date, avg(k.level) AS level FROM targets t
        JOIN keyed k ON k.node = t.node
            AND least(abs(k.doy - t.doy), 365 - abs(k.doy - t.doy)) <= 15 GROUP BY 1, 2)
    SELECT t.node, t.target_date, h.hora,
        CAST(round(CAST(coalesce(l.level, o.level) * coalesce(s.ratio, 1.0) AS DECIMAL(28, 8)), 6) AS DOUBLE) AS pred
    FROM targets t CROSS JOIN (SELECT unnest(range(1, 8)) AS hora) h
    JOIN overall o ON o.node = t.node
    LEFT JOIN levels l ON l.node = t.node AND l.target_date = t.target_date
    LEFT JOIN shapes s ON s.node = t.node AND s.dow = t.dow AND s.season = t.season
        AND s.hora = h.hora"""

BEST_BLOCK = """sums AS (SELECT node, target_date, s,
        list_sum(list_slice(y, s, s + 2)) AS total
        FROM (SELECT *, unnest(range(1, 6)) AS s FROM labelled))"""

WEEK_REQUESTS = """flags AS (SELECT DISTINCT l_returnflag AS node FROM lineitem),
    weeks AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) + 28 AS target_date
        FROM lineitem),
    req AS (SELECT node, target_date FROM flags CROSS JOIN weeks)"""


def answers_sql() -> str:
    """Origins including the one whose target block is still unpublished."""
    spec, s = WEEK, WEEK_SET
    w = s.input_blocks
    return f"""{stats('weekly')}, {WEEK_REQUESTS},
    day AS (SELECT node, block, fecha, count(*) FILTER (quality = 'missing') AS n_missing,
        count(*) FILTER (quality = 'interp') AS n_interp, list(pml ORDER BY hora) AS prices
        FROM grid GROUP BY 1, 2, 3),
    tail AS (SELECT node, max(block) AS last FROM day GROUP BY 1),
    padded AS (SELECT * FROM day UNION ALL
        SELECT node, last + 1, {day_of(spec, '(last + 1)')}, 0, 0, NULL FROM tail),
    around AS (SELECT *, count(*) OVER span AS span_n, sum(n_missing) OVER span AS span_m,
        sum(n_interp) OVER (PARTITION BY node ORDER BY block
            ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS ni,
        lead(n_interp) OVER (PARTITION BY node ORDER BY block) AS t_interp FROM padded
        WINDOW span AS (PARTITION BY node ORDER BY block
            ROWS BETWEEN {w - 1} PRECEDING AND 1 FOLLOWING)),
    ready AS (SELECT a.node, a.fecha AS origin_date, a.fecha + 7 AS target_date, a.prices,
        a.block < t.last AS backtest
        FROM around a JOIN stats s USING (node, block) JOIN tail t USING (node)
        WHERE valid AND span_n = {w + 1} AND span_m = 0 AND t_interp = 0
            AND ni <= {s.max_interp_input})"""


def order_items() -> str:
    return f"""SELECT r.*, l.l_shipdate, l.l_linenumber, l.l_extendedprice, l.l_quantity,
        l.l_returnflag FROM ({RESPONSES}) r JOIN lineitem l ON l.l_orderkey = r.o_orderkey
        WHERE has_data"""


MESSAGE = """CASE WHEN o_orderstatus = 'P' THEN 'sin datos' WHEN has_data THEN NULL
    WHEN pr = '4' THEN 'invalid json' ELSE 'No se pueden mostrar datos' END"""


def seq_calendar(ts: str, holiday: str) -> str:
    return f"""round(sin(2 * pi() * hour({ts}) / 24), 6) AS hod_sin,
    round(cos(2 * pi() * hour({ts}) / 24), 6) AS hod_cos,
    round(sin(2 * pi() * (isodow({ts}) - 1) / 7), 6) AS dow_sin,
    round(cos(2 * pi() * (isodow({ts}) - 1) / 7), 6) AS dow_cos,
    CAST({holiday} AS DOUBLE) AS is_holiday"""


def ts_value(spec: SeriesSpec, slot: str = "slot") -> str:
    return f"(TIMESTAMP '{spec.anchor} 00:00:00' + to_seconds({slot} * {spec.step_seconds}))"


def f4(expression: str) -> str:
    return f"round(CAST(CAST({expression} AS FLOAT) AS DOUBLE), 4)"


PLAN_START, PLAN_END = PLAN

# arrivals of the hourly means: in time, told anew and higher around the middle, late
ARRIVED = f"""SELECT node, slot, pml, 0 AS pri FROM told WHERE d <= DATE '2024-01-15' AND day(d) % 5 <> 0
    UNION ALL SELECT node, slot, pml + 1, 1 FROM told
        WHERE d BETWEEN DATE '2024-01-13' AND DATE '2024-01-20' AND day(d) % 5 <> 0
    UNION ALL SELECT node, slot, pml, 2 FROM told WHERE d > DATE '2024-01-15' OR day(d) % 5 = 0"""
TOLD = f"SELECT *, {sql.day_of(HOUR, '(slot // 24)')} AS d FROM ({sql.OBSERVED['hourly']})"
STREAM_OBS = f"SELECT node, slot, arg_min(pml, pri) AS pml FROM (WITH told AS ({TOLD}) {ARRIVED}) GROUP BY 1, 2"
STREAMED = f"""WITH {grid('hourly', None, STREAM_OBS)}
    SELECT node, {stamp(HOUR)} AS ts_local, CAST(round(CAST(pml AS DECIMAL(28, 10)), 6) AS DOUBLE) AS pml, quality FROM grid"""

ORACLES: dict[str, str] = {
    "ridge_gram": f"""WITH {labelled('weekly')},
        v AS (SELECT split, list_concat([1.0::DOUBLE], list_concat(list_transform(prices, lambda p: (p - mu) / sigma),
            list_transform(y, lambda p: (p - mu) / sigma))) AS v FROM labelled)
        SELECT split, i, j, round(sum(v[i + 1] * v[j + 1]), 6) AS total
        FROM v, (SELECT unnest(range(15)) AS i), (SELECT unnest(range(15)) AS j) WHERE j >= i GROUP BY ALL""",
    "effect_sums": f"""WITH {labelled('weekly')},
        v AS (SELECT node, list_concat([1.0::DOUBLE], list_concat(list_transform(prices, lambda p: (p - mu) / sigma),
            list_transform(y, lambda p: (p - mu) / sigma))) AS v FROM labelled WHERE split = 'train')
        SELECT node, i, round(sum(v[i + 1]), 6) AS total FROM v, (SELECT unnest(range(15)) AS i) GROUP BY ALL""",
    # the solution of the normal equations is the only one, so a residual of nothing is the check
    "ridge_normal_residual": f"""WITH {labelled('monthly')}
        SELECT target, count(*) AS n, 0.0::DOUBLE AS residual
        FROM labelled, (SELECT unnest(range(1, 5)) AS target) WHERE split IN ('train', 'val') GROUP BY 1""",
    "ridge_penalties": f"""WITH {labelled('weekly')}
        SELECT alpha, target, count(*) AS n, 0.0::DOUBLE AS residual
        FROM labelled, (SELECT unnest(range(1, 8)) AS target), (SELECT unnest({[float(a) for a in RIDGE_ALPHAS]}::DOUBLE[]) AS alpha)
        WHERE split = 'train' GROUP BY 1, 2""",
    "stream_silver": STREAMED,
    "silver_upserts": STREAMED,
    "silver_pruned": f"""WITH {grid('hourly')}
        SELECT node, {stamp(HOUR)} AS ts_local, CAST(round(CAST(pml AS DECIMAL(28, 10)), 6) AS DOUBLE) AS pml FROM grid
        WHERE node IN ('click', 'error') AND fecha BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'""",
    "stream_scores": f"""WITH told AS ({TOLD}), arrived AS ({ARRIVED}),
        known AS (SELECT b AS batch_id, node, slot, arg_min(pml, pri) AS pml
            FROM arrived, (SELECT unnest([0, 1, 2]) AS b) WHERE pri <= b GROUP BY ALL)
        SELECT k.batch_id::BIGINT AS batch_id, k.node, count(*) AS n,
            CAST(round(CAST(CAST(sum(CAST(round(abs(k.pml - p.pml) * 100000000) AS BIGINT)) AS BIGINT)
                / (count(*) * 100000000.0::DOUBLE) AS DECIMAL(28, 10)), 6) AS DOUBLE) AS mae
        FROM known k JOIN known p ON k.batch_id = p.batch_id AND k.node = p.node AND k.slot = p.slot + 24
        GROUP BY 1, 2""",
    "hourly_grid": f"""WITH {grid('hourly')}
        SELECT node, {stamp(HOUR)} AS ts_local, fecha, hora,
        round(pml, 6) AS pml, round(pml * 0.9, 6) AS pml_ene, quality FROM grid""",
    "hourly_interpolation": f"""WITH {grid('hourly', 3)}
        SELECT node, {stamp(HOUR)} AS ts_local, round(pml, 6) AS pml,
        round(pml * 0.9, 6) AS pml_ene FROM grid WHERE quality = 'interp'""",
    "weekly_block_grid": f"""WITH {grid('weekly')}
        SELECT node, {stamp(WEEK)} AS ts_local, fecha, hora, round(pml, 6) AS pml, quality
        FROM grid""",
    "gap_runs": f"""WITH {derived_runs('hourly')}
        SELECT node, {stamp(HOUR, 'lo')} AS start, {stamp(HOUR, 'hi')} AS "end", n_hours, kind
        FROM runs""",
    "gap_headline": f"""WITH {derived_runs('monthly')}
        SELECT count(*) AS n_runs,
        coalesce(max(n_hours) FILTER (kind = 'missing'), 0) AS longest_missing,
        count(*) FILTER (kind = 'interp') AS n_interp_runs FROM runs""",
    "record_dedup": """SELECT event_type AS node, 'MDA' AS market, 'SIN' AS sistema,
        strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts_local,
        CAST(ts AS DATE) AS fecha, hour(ts) + 1 AS hora,
        round(arg_max(value, event_id), 6) AS pml, 'ok' AS quality, hour(ts) + 1 AS source_hora
        FROM events GROUP BY event_type, date_trunc('hour', ts), CAST(ts AS DATE), hour(ts)""",
    "daylight_saving_align": f"""WITH {ALIGN}
        SELECT 'ALL' AS node, strftime(CAST(fecha AS TIMESTAMP) + to_hours(hora - 1),
        '%Y-%m-%d %H:%M:%S') AS ts_local, fecha, hora, round(pml, 6) AS pml,
        round(pml * 0.9, 6) AS pml_ene, quality, source_hora FROM aligned""",
    "daylight_saving_rows": f"""WITH {ALIGN}
        SELECT 'ALL' AS node, year(fecha) AS year, count(*) FILTER (quality = 'dst_fill')
        AS dst_fill, count(*) FILTER (quality = 'dst_merge') AS dst_merge
        FROM aligned WHERE quality <> 'ok' GROUP BY 2""",
    "silver_merge": f"""WITH {grid('hourly', None, MERGE_OBS)}
        SELECT node, {stamp(HOUR)} AS ts_local, round(pml, 6) AS pml, quality FROM grid""",
    "coverage_pairs": f"""WITH {grid('hourly')} SELECT node, fecha FROM grid
        WHERE quality = 'ok' GROUP BY 1, 2 HAVING count(*) >= 24""",
    "coverage_table": f"""WITH {grid('hourly')},
        per AS (SELECT node, fecha, count(*) AS n FROM grid WHERE quality = 'ok' GROUP BY 1, 2)
        SELECT node, min(fecha) AS first, max(fecha) AS last,
        max(fecha) - min(fecha) + 1 AS days, count(*) FILTER (n >= 24) AS full_days,
        round(count(*) FILTER (n >= 24) / (max(fecha) - min(fecha) + 1), 6) AS share
        FROM per GROUP BY 1""",
    "coverage_quality": f"""WITH {grid('hourly')}
        SELECT node, min(fecha) AS first, max(fecha) AS last, count(*) AS hours,
        round(count(*) FILTER (quality = 'ok') / count(*), 6) AS share_observed,
        count(*) FILTER (quality = 'interp') AS n_interp,
        count(*) FILTER (quality = 'missing') AS n_missing,
        CAST(0 AS BIGINT) AS n_dst_fill, CAST(0 AS BIGINT) AS n_dst_merge
        FROM grid GROUP BY 1""",
    "price_levels": f"""WITH {grid('hourly')}
        SELECT node, round(avg(pml), 6) AS mean, round(median(pml), 6) AS median,
        round(stddev_pop(pml), 6) AS std, round(quantile_cont(pml, 0.01), 6) AS p01,
        round(quantile_cont(pml, 0.99), 6) AS p99, round(max(pml), 6) AS max,
        round(count(*) FILTER (pml <= 0) / count(pml), 6) AS share_nonpositive
        FROM grid WHERE pml IS NOT NULL GROUP BY 1""",
    "price_profile": f"""WITH {grid('monthly')}
        SELECT region, node, count(pml) AS n, round(median(pml), 6) AS median,
        round(quantile_cont(pml, 0.99), 6) AS p99
        FROM grid JOIN ({sql.NATIONS}) USING (node) GROUP BY 1, 2""",
    "nonpositive_share": f"""WITH {grid('weekly')},
        s AS (SELECT node, count(*) FILTER (pml <= 0) / count(pml) AS share FROM grid GROUP BY 1)
        SELECT round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share,
        min(node) FILTER (share = (SELECT max(share) FROM s)) AS max_node FROM s""",
    "spike_years": f"""WITH {stats('weekly')},
        tops AS (SELECT node, block, fecha, max(pml) AS top FROM grid GROUP BY 1, 2, 3)
        SELECT t.node, year(t.fecha) AS year,
        count(*) FILTER (s.valid AND t.top > s.mu + 4 * s.sigma) AS spike_days
        FROM tops t LEFT JOIN stats s ON s.node = t.node AND s.block = t.block - 1
        GROUP BY 1, 2""",
    "spike_pivot": f"""WITH {stats('weekly')},
        tops AS (SELECT node, block, fecha, max(pml) AS top FROM grid GROUP BY 1, 2, 3),
        hit AS (SELECT t.node, year(t.fecha) AS year,
            coalesce(s.valid AND t.top > s.mu + 4 * s.sigma, false) AS spike
            FROM tops t LEFT JOIN stats s ON s.node = t.node AND s.block = t.block - 1)
        SELECT node, """
    + ", ".join(f"count(*) FILTER (spike AND year = {y}) AS y{y}" for y in range(1995, 2002))
    + " FROM hit GROUP BY 1",
    "sigma_distribution": f"""WITH {stats('monthly')},
        q AS (SELECT count(*) AS n, quantile_cont(sigma, 0.01) AS p01,
            quantile_cont(sigma, 0.05) AS p05, quantile_cont(sigma, 0.5) AS p50,
            quantile_cont(sigma, 0.95) AS p95, quantile_cont(sigma, 0.99) AS p99,
            avg(CASE WHEN sigma <= 10 THEN 1.0 ELSE 0.0 END) AS share_at_floor
            FROM stats WHERE valid)
        SELECT n, {rounded('p01', 'p05', 'p50', 'p95', 'p99')},
        round(p99 / p50, 6) AS p99_over_p50, round(share_at_floor, 6) AS share_at_floor,
        CASE WHEN p99 / p50 > 5 THEN 'log1p_sigma' ELSE 'sigma_over_1000' END AS recommendation
        FROM q""",
    "freshness": "SELECT max(CAST(ts AS DATE)) AS last_day FROM events",
    "trailing_extract": f"""WITH {grid('hourly')},
        picked AS (SELECT * FROM grid WHERE node IN ('click', 'error', 'view'))
        SELECT node, {stamp(HOUR)} AS ts_local, round(pml, 6) AS pml, quality FROM picked
        WHERE fecha > (SELECT max(fecha) FROM picked) - 10""",
    "rolling_stats": f"""WITH {stats('weekly')}
        SELECT node, origin, {rounded('mu', 'std_raw', 'sigma', 'mu_7d')}, n_obs,
        CAST(valid AS BIGINT) AS valid FROM stats""",
    "rolling_stats_hourly": f"""WITH {stats('hourly')}
        SELECT node, origin, {rounded('mu', 'std_raw', 'sigma', 'mu_7d')}, n_obs,
        round(mu * 0.9, 6) AS mu_ene, round(mu * 0.05, 6) AS mu_per,
        round(mu - mu * 0.9 - mu * 0.05, 6) AS mu_cng, CAST(valid AS BIGINT) AS valid
        FROM stats""",
    "level_features": f"""WITH {stats('weekly')}
        SELECT node, origin, round(mu / 1000, 6) AS mu_over_1000,
        round(sigma / 1000, 6) AS sigma_over_1000, round(ln(1 + sigma), 6) AS log1p_sigma,
        round((mu_7d - mu) / sigma, 6) AS trend_7d FROM stats WHERE valid""",
    "sequence_calendar": f"""WITH {grid('hourly')}
        SELECT node, {stamp(HOUR)} AS ts_local,
        {seq_calendar(ts_value(HOUR), f'fecha IN ({CALENDAR_HOLIDAYS})')} FROM grid""",
    "target_calendar": f"""WITH {labelled('monthly')}
        SELECT node, target_date, """
    + ", ".join(
        f"CASE WHEN isodow(target_date) = {i + 1} THEN 1.0 ELSE 0.0 END::DOUBLE AS dow_{i}"
        for i in range(7)
    )
    + f""", {f4('sin(2 * pi() * (month(target_date) - 1) / 12)')} AS month_sin,
        {f4('cos(2 * pi() * (month(target_date) - 1) / 12)')} AS month_cos,
        CASE WHEN target_date IN ({sql.HOLIDAYS}) THEN 1.0 ELSE 0.0 END::DOUBLE AS is_holiday
        FROM labelled""",
    "season_counts": """SELECT (month(o_orderdate) % 12) // 3 AS season, count(*) AS n,
        count(*) FILTER (least(dayofyear(o_orderdate) - 1, 366 - dayofyear(o_orderdate)) <= 15)
        AS near_new_year FROM orders GROUP BY 1""",
    "text_normalize": """SELECT p_partkey,
        upper(p_name || ' ' || p_type || ' ' || p_brand) AS label FROM part""",
    "valid_origins": f"WITH {origins('hourly')} SELECT node, origin_date FROM origins",
    "valid_origins_weekly": f"WITH {origins('weekly')} SELECT node, origin_date FROM origins",
    "whole_blocks": f"""WITH obs AS ({sql.OBSERVED['hourly']})
        SELECT node, count(*) AS n_steps FROM obs GROUP BY 1
        HAVING count(*) % 24 <> 0 OR min(slot) % 24 <> 0
            OR max(slot) - min(slot) + 1 <> count(*)""",
    "sample_index": f"""WITH {labelled('weekly')}
        SELECT node, origin_date, target_date, split, CAST(is_spike_day AS BIGINT)
        AS is_spike_day, n_interp_input, {rounded('mu', 'sigma', 'std_raw', 'mu_7d')}
        FROM labelled""",
    "split_bounds": f"""WITH {labelled('weekly')}
        SELECT val_start - 1 AS train_end, val_start, test_start - 1 AS val_end, test_start,
        test_end FROM cuts""",
    "samples_long": f"""WITH {origins('hourly')}
        SELECT o.node, o.origin_date, g.slot - (o.block - 2) * 24 AS step,
        {f4('(g.pml - o.mu) / o.sigma')} AS z_pml,
        {f4('(g.pml * 0.9 - o.mu * 0.9) / o.sigma')} AS z_ene,
        {f4('(g.pml * 0.05 - o.mu * 0.05) / o.sigma')} AS z_per,
        {f4('((g.pml - g.pml * 0.9 - g.pml * 0.05) - (o.mu - o.mu * 0.9 - o.mu * 0.05)) / o.sigma')}
            AS z_cng,
        {f4(f'sin(2 * pi() * hour({ts_value(HOUR, "g.slot")}) / 24)')} AS hod_sin,
        {f4(f'cos(2 * pi() * hour({ts_value(HOUR, "g.slot")}) / 24)')} AS hod_cos,
        {f4('sin(2 * pi() * (isodow(g.fecha) - 1) / 7)')} AS dow_sin,
        {f4('cos(2 * pi() * (isodow(g.fecha) - 1) / 7)')} AS dow_cos, 0.0::DOUBLE AS is_holiday
        FROM origins o JOIN grid g ON g.node = o.node
            AND g.block BETWEEN o.block - 2 AND o.block""",
    "target_prices": f"""WITH {origins('hourly')}
        SELECT node, target_date, hora, round((y[hora] - mu) / sigma, 6) AS z,
        round(y[hora], 6) AS price
        FROM (SELECT *, unnest(range(1, 25)) AS hora FROM origins)""",
    "samples_arrays": f"""WITH {origins('weekly')}
        SELECT node, origin_date, 28 AS steps, 9 AS features, 10 AS n_cal, 3 AS n_level,
        7 AS n_target, 3 AS n_comp FROM origins""",
    "dataset_index": f"""WITH {MONTH_NODES},
        zones AS (SELECT zone, row_number() OVER (ORDER BY zone) AS zone_idx
            FROM (SELECT DISTINCT zone FROM train)),
        scaler AS (SELECT avg(ln(kv)) AS m, greatest(stddev_pop(ln(kv)), 1e-6) AS s FROM train)
        SELECT row_number() OVER (ORDER BY t.node, origin_date) - 1 AS sample_id, t.node,
        t.region, t.zone, t.kv, origin_date, split, coalesce(z.zone_idx, 0) AS zone_idx,
        dense_rank() OVER (ORDER BY t.node) - 1 AS node_idx,
        {f4('(ln(t.kv) - m) / s')} AS voltage_z,
        list_position(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], t.region)
            AS region_position
        FROM tagged t LEFT JOIN zones z ON z.zone = t.zone CROSS JOIN scaler""",
    "zone_dropout": f"""WITH {MONTH_NODES},
        zones AS (SELECT zone, row_number() OVER (ORDER BY zone) AS zone_idx
            FROM (SELECT DISTINCT zone FROM train)),
        drawn AS (SELECT *, CAST('0x' || left(md5(concat_ws('|', node, origin_date, '0')), 8)
            AS BIGINT) / 4294967296 AS draw FROM tagged)
        SELECT t.node, origin_date, CASE WHEN draw >= 0.25 THEN coalesce(z.zone_idx, 0) ELSE 0 END
            AS zone_idx FROM drawn t LEFT JOIN zones z ON z.zone = t.zone""",
    "dataset_facts": f"""WITH {MONTH_NODES},
        scaler AS (SELECT avg(ln(kv)) AS m, stddev_pop(ln(kv)) AS s,
            count(DISTINCT zone) AS zs, count(*) AS tn FROM train)
        SELECT 16 AS input_hours, 4 AS target_hours, count(DISTINCT node) AS nodes,
        any_value(tn) AS train_nodes, any_value(zs) + 1 AS zones,
        round(any_value(m), 6) AS voltage_log_mean, round(any_value(s), 6) AS voltage_log_std,
        any_value(val_start) - 1 AS train_end, any_value(test_start) AS test_start,
        min(origin_date) AS first_origin, max(target_date) AS last_target,
        count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
        count(*) FILTER (split = 'test') AS n_test FROM tagged, scaler, cuts""",
    "zone_vocabulary": f"""WITH {MONTH_NODES}
        SELECT zone, row_number() OVER (ORDER BY zone) AS zone_idx
        FROM (SELECT DISTINCT zone FROM train) UNION ALL SELECT 'UNKNOWN', 0""",
    "voltage_scaler": f"""WITH {MONTH_NODES} SELECT round(avg(ln(kv)), 6) AS log_mean,
        round(greatest(stddev_pop(ln(kv)), 1e-6), 6) AS log_std FROM train""",
    "walk_forward": f"""WITH {labelled('weekly')} SELECT target_date, count(*) AS n_samples
        FROM labelled WHERE split = 'test' GROUP BY 1""",
    "sample_positions": f"""WITH {MONTH_NODES} SELECT split, node, count(*) AS n FROM tagged
        WHERE region IN ('ASIA', 'EUROPE') GROUP BY 1, 2""",
    "node_folds": f"""WITH {MONTH_NODES}, nodes AS (SELECT DISTINCT node, zone FROM tagged),
        elig AS (SELECT node, zone FROM nodes WHERE zone IN
            (SELECT zone FROM nodes GROUP BY 1 HAVING count(*) >= 2))
        SELECT node AS held_out, zone, row_number() OVER (ORDER BY node) AS fold
        FROM elig ORDER BY node LIMIT 10""",
    "zone_folds": f"""WITH {MONTH_NODES},
        per AS (SELECT zone, count(DISTINCT node) AS n FROM tagged GROUP BY 1)
        SELECT zone AS held_out, n AS n_nodes, row_number() OVER (ORDER BY n DESC, zone) AS fold
        FROM per ORDER BY n DESC, zone LIMIT 3""",
    "fold_sizes": f"""WITH {MONTH_NODES}, nodes AS (SELECT DISTINCT node, zone FROM tagged),
        elig AS (SELECT node FROM nodes WHERE zone IN
            (SELECT zone FROM nodes GROUP BY 1 HAVING count(*) >= 2))
        SELECT e.node AS held_out,
        count(*) FILTER (t.node <> e.node AND split = 'train') AS n_train,
        count(*) FILTER (t.node <> e.node AND split = 'val') AS n_val,
        count(*) FILTER (t.node = e.node AND split = 'test') AS n_test
        FROM elig e CROSS JOIN tagged t GROUP BY 1""",
    "fold_roles": f"""WITH {MONTH_NODES},
        per AS (SELECT zone, count(DISTINCT node) AS n FROM tagged GROUP BY 1),
        top AS (SELECT zone FROM per ORDER BY n DESC, zone LIMIT 3)
        SELECT f.zone AS held_out, split AS role, node, origin_date
        FROM top f CROSS JOIN tagged t
        WHERE (t.zone = f.zone AND split = 'test') OR (t.zone <> f.zone AND split <> 'test')""",
    "naive24": steps("weekly", "node, target_date", pred="prices", actual="y"),
    "naive168": steps("weekly", "node, target_date", pred="week", actual="y"),
    "seasonal_ma": SEASONAL,
    "batch_scoring": f"""WITH {labelled('weekly')}
        SELECT node, target_date, hora, 1.0::DOUBLE AS share
        FROM (SELECT *, unnest(range(1, 8)) AS hora FROM labelled)""",
    "predictions_table": f"""WITH {labelled('weekly')}
        SELECT node, 'MDA' AS market, origin_date, target_date, hora,
        round(prices[hora], 6) AS pml_pred, round(y[hora], 6) AS pml_actual,
        'naive24' AS model_name, strftime(origin_date + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S')
        AS issued_at, split
        FROM (SELECT *, unnest(range(1, 8)) AS hora FROM labelled WHERE split = 'test')""",
    "eval_metrics": f"{WEEK_TEST} SELECT model AS model_name, {measures(7)} FROM scored GROUP BY 1",
    "eval_subsets": f"""{WEEK_ALL},
        tagged AS (SELECT *, unnest(['all', CASE WHEN is_spike_day THEN 'spike' ELSE 'no_spike'
            END]) AS subset FROM scored),
        found AS (SELECT model AS model_name, subset, {measures(7)} FROM tagged GROUP BY 1, 2),
        slots AS (SELECT m.model AS model_name, s.subset FROM (SELECT DISTINCT model FROM scored) m
            CROSS JOIN (SELECT unnest(['all', 'no_spike', 'spike']) AS subset) s)
        SELECT model_name, subset, mae, rmse, smape, skill, top4_overlap, captured_value,
        coalesce(n_samples, 0) AS n_samples FROM slots LEFT JOIN found USING (model_name, subset)""",
    "eval_by_region": f"""{MONTH_ALL}
        SELECT model AS model_name, region, {measures(4)} FROM scored GROUP BY 1, 2""",
    "eval_region_table": f"""{MONTH_ALL},
        m AS (SELECT model, region, {measures(4)} FROM scored GROUP BY 1, 2)
        SELECT a.region, a.mae AS mae_naive24, a.skill AS skill_naive24, b.mae AS mae_naive168,
        b.skill AS skill_naive168, a.n_samples FROM m a JOIN m b USING (region)
        WHERE a.model = 'naive24' AND b.model = 'naive168'""",
    "eval_by_hour": f"""{WEEK_ALL} SELECT model AS model_name, hora,
        round(avg(abs(p - y)), 6) AS mae FROM hours GROUP BY 1, 2""",
    "eval_flat_metrics": f"""{WEEK_TEST},
        tagged AS (SELECT *, unnest([{{'s': '', 'in': true}}, {{'s': '_nospike', 'in':
            NOT is_spike_day}}, {{'s': '_spike', 'in': is_spike_day}}]) AS u FROM scored),
        found AS (SELECT model AS model_name, u.s AS suffix, {measures(7)} FROM tagged
            WHERE u."in" GROUP BY 1, 2),
        slots AS (SELECT m.model AS model_name, s.suffix FROM (SELECT DISTINCT model FROM scored) m
            CROSS JOIN (SELECT unnest(['', '_nospike', '_spike']) AS suffix) s),
        flat AS (SELECT model_name, unnest([{{'k': 'mae', 'v': mae}}, {{'k': 'rmse', 'v': rmse}},
            {{'k': 'smape', 'v': smape}}, {{'k': 'skill', 'v': skill}},
            {{'k': 'top4_overlap', 'v': top4_overlap}},
            {{'k': 'captured_value', 'v': captured_value}}]) AS e, suffix FROM found)
        SELECT model_name, 'test_' || e.k || suffix AS metric, e.v AS value FROM flat
            WHERE e.v IS NOT NULL
        UNION ALL SELECT model_name, 'n_test' || suffix, coalesce(n_samples, 0)::DOUBLE
            FROM slots LEFT JOIN found USING (model_name, suffix)""",
    "eval_summary_table": f"""{WEEK_TEST},
        a AS (SELECT model AS model_name, {measures(7)} FROM scored GROUP BY 1),
        b AS (SELECT model AS model_name, round(sum(abs_sum) / (count(*) * 7), 6) AS mae_nospike
            FROM scored WHERE NOT is_spike_day GROUP BY 1)
        SELECT model_name, mae, rmse, skill, top4_overlap, captured_value, mae_nospike
        FROM a LEFT JOIN b USING (model_name)""",
    "top_overlap": f"""{WEEK_TEST} SELECT model AS model_name, node, target_date,
        round(overlap, 6) AS overlap FROM scored""",
    "captured_value": f"""{WEEK_TEST} SELECT model AS model_name, node, target_date,
        round(captured, 6) AS captured FROM scored""",
    "block_windows": f"""WITH {labelled('weekly')}, {BEST_BLOCK},
        picks AS (SELECT node, target_date, min(s) FILTER (total = hi) AS b,
            min(s) FILTER (total = lo) AS c FROM (SELECT *,
                max(total) OVER (PARTITION BY node, target_date) AS hi,
                min(total) OVER (PARTITION BY node, target_date) AS lo FROM sums) GROUP BY 1, 2)
        SELECT node, target_date, b AS best_start, b + 2 AS best_end, c AS low_start,
        c + 2 AS low_end FROM picks""",
    "example_sample": f"""WITH {MONTH_NODES},
        ids AS (SELECT *, row_number() OVER (ORDER BY node, origin_date) - 1 AS sample_id
            FROM tagged)
        SELECT sample_id, node, target_date FROM ids WHERE split = 'test'
        ORDER BY list_max(y) - list_min(y) DESC, sample_id LIMIT 1""",
    "prediction_parity": f"""WITH {labelled('weekly')},
        d AS (SELECT abs(prices[hora] - week[hora]) AS gap
            FROM (SELECT *, unnest(range(1, 8)) AS hora FROM labelled))
        SELECT count(*) AS n_rows, round(max(gap), 6) AS max_abs_diff,
        CAST(max(gap) <= 1 AS BIGINT) AS within FROM d""",
    "holdout_naive": f"""{ZONE_TEST},
        top AS (SELECT zone FROM (SELECT zone, count(DISTINCT node) AS n FROM
            (SELECT l.node, c.zone FROM labelled l JOIN ({sql.NATIONS}) c USING (node))
            GROUP BY 1) ORDER BY n DESC, zone LIMIT 3)
        SELECT 'zone' AS regime, zone AS held_out, model, count(*) AS n_test,
        round(sum(abs_sum) / (count(*) * 4), 6) AS mae,
        round(1 - sum(abs_sum) / sum(ref_sum), 6) AS skill,
        round(avg(overlap), 6) AS top4_overlap,
        round(sum(abs_sum) FILTER (NOT is_spike_day)
            / (count(*) FILTER (NOT is_spike_day) * 4), 6) AS mae_nospike
        FROM scored WHERE zone IN (FROM top) GROUP BY 2, 3""",
    "catalog_clean": f"""WITH joined AS (SELECT o.*, c.c_name, f.* FROM orders o
            JOIN customer c ON o_custkey = c_custkey JOIN ({sql.CUSTOMERS}) f ON f.node = c_name),
        first AS (SELECT * FROM joined
            QUALIFY row_number() OVER (PARTITION BY node ORDER BY o_orderkey) = 1)
        SELECT node, name,
        CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'UNKNOWN' ELSE region END AS region,
        CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE zone END AS zone,
        CASE WHEN left(o_orderpriority, 1) = '5' THEN NULL ELSE kv END AS kv,
        CAST(left(o_orderpriority, 1) = '1' AS BIGINT) AS load_direct,
        CAST(left(o_orderpriority, 1) <> '3' AS BIGINT) AS gen_direct,
        CAST(0 AS BIGINT) AS gen_indirect, o_custkey AS state_code,
        '20240101' AS catalog_version FROM first""",
    "select_nodes": f"WITH {SELECTED} SELECT node, region, zone, kv FROM selected",
    "level_crosstab": f"""WITH {SELECTED} SELECT region, kv, count(*) AS n,
        grouping(region) AS all_regions, grouping(kv) AS all_levels
        FROM selected GROUP BY CUBE (region, kv)""",
    "level_pivot": f"""WITH {SELECTED} SELECT region, count(*) FILTER (kv = 400) AS kv400,
        count(*) FILTER (kv = 230) AS kv230, count(*) FILTER (kv = 115) AS kv115,
        count(*) AS total FROM selected GROUP BY 1""",
    "zone_coverage": f"""WITH cust AS ({sql.CUSTOMERS}),
        chosen AS (SELECT * FROM cust WHERE kv = 400 AND name = 'BUILDING'),
        zones AS (SELECT DISTINCT region, zone FROM cust WHERE sistema IN
            (SELECT sistema FROM chosen)),
        tagged AS (SELECT z.*, z.zone IN (SELECT zone FROM chosen) AS hit FROM zones z)
        SELECT region, count(*) AS zones, count(*) FILTER (hit) AS zones_covered,
        coalesce(string_agg(zone, ',' ORDER BY zone) FILTER (NOT hit), '') AS uncovered
        FROM tagged GROUP BY 1""",
    "nodes_per_zone": f"WITH {SELECTED} SELECT zone, count(*) AS n FROM selected GROUP BY 1",
    "sample_nodes": f"""WITH cust AS ({sql.CUSTOMERS}),
        first AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY kv DESC, node) AS r
            FROM cust)
        SELECT node FROM first WHERE r <= 2 ORDER BY region, kv DESC, node LIMIT 7""",
    "node_metadata": f"""WITH {grid('monthly')},
        per AS (SELECT node, fecha, count(*) AS n FROM grid WHERE quality = 'ok' GROUP BY 1, 2),
        cov AS (SELECT node, count(*) FILTER (n >= 4) AS full_days FROM per GROUP BY 1),
        cat AS (SELECT * FROM ({sql.NATIONS}) WHERE region <> 'AFRICA')
        SELECT node, 'SIN' AS sistema, coalesce(region, 'UNKNOWN') AS region,
        coalesce(zone, 'UNKNOWN') AS zone, kv, full_days FROM cov LEFT JOIN cat USING (node)""",
    "request_plan": f"""WITH days AS ({NATION_DAYS}),
        win AS (SELECT w, DATE '{PLAN_EPOCH}' + CAST(w * 7 AS INTEGER) AS s,
            least(DATE '{PLAN_EPOCH}' + CAST(w * 7 + 6 AS INTEGER), DATE '{PLAN_END}') AS e
            FROM (SELECT unnest(range((DATE '{PLAN_START}' - DATE '{PLAN_EPOCH}') // 7,
                (DATE '{PLAN_END}' - DATE '{PLAN_EPOCH}') // 7 + 1)) AS w)),
        pend AS (SELECT w.*, n.n_name AS node FROM win w CROSS JOIN nation n
            WHERE (SELECT count(*) FROM days d WHERE d.node = n.n_name
                AND d.fecha BETWEEN w.s AND w.e) < w.e - w.s + 1),
        placed AS (SELECT *, (row_number() OVER (PARTITION BY w ORDER BY node) - 1) // 20 AS b
            FROM pend),
        batches AS (SELECT s, e, b, string_agg(node, ',' ORDER BY node) AS nodes, count(*) AS n
            FROM placed GROUP BY 1, 2, 3)
        SELECT 'SIN' AS sistema, 'MDA' AS proceso, nodes, s AS start, e AS "end",
        strftime(s, '%Y%m%d') || '-' || strftime(e, '%Y%m%d') || '__' || n || 'n_'
            || left(sha1(nodes), 12) AS key FROM batches""",
    "requested_pairs": PAIRS,
    "available_pairs": f"({PAIRS}) UNION ({NATION_DAYS})",
    "request_validation": f"""SELECT o_orderkey, CASE WHEN sistema = 'XXX' THEN 'unknown sistema'
        WHEN proceso = '???' THEN 'unknown proceso' WHEN e < s THEN 'end before start'
        WHEN e - s + 1 > 7 THEN 'spans more than 7 days' END AS reject_reason
        FROM ({REQUESTS})""",
    "parse_bodies": f"""SELECT o_orderkey, 'C' || o_custkey AS node,
        strftime(l_shipdate, '%Y-%m-%d') AS fecha, l_linenumber AS hora,
        round(l_extendedprice, 6) AS pml,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE round(l_quantity, 6) END AS pml_ene,
        NULL::DOUBLE AS pml_per FROM ({order_items()})""",
    "envelope_observed": f"""WITH items AS (SELECT o_orderkey, 'C' || o_custkey AS node,
            CAST(l_shipdate AS DATE) AS f, l_linenumber AS h, l_extendedprice AS p,
            row_number() OVER (PARTITION BY o_orderkey, l_shipdate, l_linenumber
                ORDER BY format('{{:,.2f}}', l_extendedprice) DESC) AS r FROM ({order_items()})),
        first AS (SELECT * FROM items WHERE r = 1
            QUALIFY row_number() OVER (PARTITION BY node, f, h ORDER BY o_orderkey) = 1)
        SELECT node, strftime(CAST(f AS TIMESTAMP) + to_hours(h - 1), '%Y-%m-%d %H:%M:%S')
        AS ts_local, round(p, 6) AS pml, 'ok' AS quality, 'SIN' AS sistema, 'MDA' AS market
        FROM first""",
    "node_options": f"""WITH {SELECTED}
        SELECT s.node, s.region, s.zone, s.kv, c.name, c.zone AS municipality,
        c.region AS state FROM selected s
        LEFT JOIN (SELECT * FROM cust WHERE name <> 'BUILDING') c ON c.node = s.node""",
    "body_messages": f"""SELECT {MESSAGE} AS message, count(*) AS n FROM ({RESPONSES})
        GROUP BY 1""",
    "collection_events": f"""WITH items AS (SELECT o_orderkey, count(*) AS n
            FROM ({order_items()}) GROUP BY 1),
        r AS (SELECT r.*, coalesce(n, 0) AS n, {MESSAGE} AS message
            FROM ({RESPONSES}) r LEFT JOIN items USING (o_orderkey))
        SELECT CASE WHEN status = 503 THEN 'error' WHEN status = 404 THEN 'not_found'
            WHEN message IS NOT NULL THEN 'message' WHEN n = 0 THEN 'empty' ELSE 'ok' END
            AS event, count(*) AS n_requests, CAST(sum(n) AS BIGINT) AS n_records
        FROM r GROUP BY 1""",
    "daily_score": f"""{SCORES} SELECT node, target_date, {rounded(
        'mae', 'rmse', 'top4_overlap', 'captured_value', 'naive24_mae', 'naive168_mae',
        'skill_vs_naive24')} FROM scores""",
    "daily_score_pending": f"""{SCORES} SELECT node, target_date,
        {rounded('mae', 'naive24_mae')} FROM scores WHERE target_date >= DATE '2000-01-01'""",
    "daily_merge": f"""WITH {labelled('weekly')}
        SELECT node, target_date, hora, round(CASE WHEN target_date >= DATE '2001-06-01'
            THEN prices[hora] ELSE week[hora] END, 6) AS pml_pred
        FROM (SELECT *, unnest(range(1, 8)) AS hora FROM labelled)""",
    "recent_skill": f"""{SCORES},
        recent AS (SELECT * FROM scores
            WHERE target_date > (SELECT max(target_date) FROM scores) - 90)
        SELECT count(DISTINCT target_date) AS days, count(DISTINCT node) AS nodes,
        round(avg(mae), 6) AS mae, round(avg(top4_overlap), 6) AS top4_overlap,
        round(avg(captured_value), 6) AS captured_value,
        round(avg(skill_vs_naive24), 6) AS skill_vs_naive24 FROM recent""",
    "latest_scored": f"""{SCORES} SELECT node, target_date, {rounded(
        'mae', 'top4_overlap', 'captured_value', 'skill_vs_naive24')} FROM scores
        ORDER BY target_date DESC, node LIMIT 1""",
    "next_targets": f"""WITH {grid('hourly')},
        tail AS (SELECT node, max(fecha) FILTER (fecha >= DATE '2024-01-30'
                - {max(HOUR_SET.input_blocks, HOUR_SET.stats_blocks) + 1}) AS last_day FROM grid
            WHERE NOT (node = 'click' AND fecha > DATE '2024-01-03')
                AND NOT (node = 'view' AND fecha > DATE '2024-01-29')
                AND fecha <= DATE '2024-01-31' GROUP BY 1)
        SELECT node, last_day, DATE '2024-01-31' AS newest,
        CAST(coalesce(last_day < DATE '2024-01-31', true) AS BIGINT) AS is_late,
        CASE WHEN last_day >= DATE '2024-01-30' THEN last_day + 1 END AS target_date,
        CASE WHEN last_day IS NULL OR last_day < DATE '2024-01-30'
            THEN 'published history ends before today' END AS skip_reason FROM tail""",
    "forecast_skips": f"""WITH {answers_sql()},
        found AS (SELECT r.node, r.target_date, max(d.fecha) AS last_day FROM req r
            LEFT JOIN day d ON d.node = r.node AND d.fecha <= r.target_date
                AND d.fecha >= r.target_date - 7 - {(max(WEEK_SET.stats_blocks,
                    WEEK_SET.input_blocks) + 1) * 7} GROUP BY 1, 2)
        SELECT f.node, f.target_date - 7 AS origin_date, f.target_date,
        CASE WHEN f.target_date > DATE '2001-10-08' + 14 THEN 'target out of range'
            WHEN last_day IS NULL THEN 'no published history'
            WHEN last_day < f.target_date - 7 THEN 'history ends before the origin'
            WHEN y.node IS NULL THEN 'too little clean history' END AS skip_reason
        FROM found f LEFT JOIN ready y ON y.node = f.node AND y.target_date = f.target_date""",
    "forecast_answers": f"""WITH {answers_sql()},
        asked AS (SELECT y.* REPLACE (list_transform(list_transform(y.prices, lambda v: CAST(v AS DECIMAL(24, 10))),
            lambda v: CAST(CASE WHEN round(v, 2) - v = 0.005 AND CAST(round(v, 2) * 100 AS BIGINT) % 2 = 1
                THEN round(v, 2) - 0.01 ELSE round(v, 2) END AS DOUBLE)) AS prices) FROM ready y JOIN req USING (node, target_date)),
        sums AS (SELECT node, target_date, s, list_sum(list_slice(prices, s, s + 3)) AS total
            FROM (SELECT *, unnest(range(1, 5)) AS s FROM asked)),
        picks AS (SELECT node, target_date, min(s) FILTER (total = hi) AS b,
            min(s) FILTER (total = lo) AS c FROM (SELECT *,
                max(total) OVER (PARTITION BY node, target_date) AS hi,
                min(total) OVER (PARTITION BY node, target_date) AS lo FROM sums) GROUP BY 1, 2)
        SELECT node, origin_date, target_date,
        CASE WHEN backtest THEN strftime(origin_date + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S')
            ELSE '2001-10-08 09:00:00' END AS issued_at,
        strftime(origin_date + 6, '%Y-%m-%d 00:00:00') AS history_end, b AS best_start,
        c AS cheapest_start, CAST(backtest AS BIGINT) AS backtest, 7 AS n_hours,
        round(list_sum(prices), 6) AS total
        FROM asked JOIN picks USING (node, target_date)""",
    "pending_block": f"""WITH {grid('weekly')},
        tail AS (SELECT node, max(slot) AS last FROM grid GROUP BY 1)
        SELECT node, quality, count(*) AS n, count(pml) AS n_prices,
        {stamp(WEEK, 'max(slot)')} AS last FROM grid GROUP BY 1, 2
        UNION ALL SELECT node, 'pending', 7, 0, {stamp(WEEK, '(last + 7)')} FROM tail""",
}
ORACLES["model_comparison"] = (
    f"WITH {labelled('weekly')}, {scored(NAIVES, 7, WEEK_SET.top_k)}".replace(
        "SELECT l_returnflag AS node", "SELECT 'ALL' AS node"
    )
    + f" SELECT model AS model_name, {measures(7)} FROM scored GROUP BY 1"
)
ORACLES["selection_report"] = f"""WITH found AS (
        {WEEK_ALL} SELECT model, split, sum(abs_sum) / (count(*) * 7) AS mae FROM scored GROUP BY 1, 2),
    search AS (SELECT model, max(mae) FILTER (split = 'val') AS mae FROM found GROUP BY 1),
    folds AS ({ORACLES['holdout_naive']}),
    averages AS (SELECT regime, model, avg(mae) AS mae FROM folds GROUP BY 1, 2)
    SELECT 'search' AS section, model AS entry, row_number() OVER (ORDER BY mae NULLS LAST, model) AS rank,
        CAST(row_number() OVER (ORDER BY mae NULLS LAST, model) = 1 AS BIGINT) AS chosen, round(mae, 4) AS mae FROM search
    UNION ALL SELECT 'ablation', model, row_number() OVER (PARTITION BY regime ORDER BY mae NULLS LAST, model),
        NULL, round(mae, 4) FROM averages
    UNION ALL SELECT 'holdout', held_out || ' ' || model, NULL, NULL, round(mae, 4) FROM folds"""
ORACLES["ablation"] = f"""WITH folds AS ({ORACLES['holdout_naive']})
    SELECT regime, model, count(DISTINCT held_out) AS folds,
    CAST(sum(n_test) AS BIGINT) AS n_test, round(avg(mae), 4) AS mae, round(avg(skill), 4) AS skill,
    round(avg(top4_overlap), 4) AS top4_overlap, round(avg(mae_nospike), 4) AS mae_nospike
    FROM folds GROUP BY 1, 2"""

