"""DuckDB statements that compute what each registered query computes, written
independently in plain SQL (window functions, self-joins, conditional
aggregates) over the driver's views."""

from __future__ import annotations

from itertools import combinations

from hourgrid.operators.model import param_sets, params_text
from hourgrid.plans.catalog import FACTOR_GRID, FILTER_REGIONS, OFF_TIES, SHORT_MODEL, TEST_SPLIT
from hourgrid.operators.boosting import BINS, BITS, CELLS
from hourgrid.schemas import CORR_COLS, FEATURE_TABLE, MODEL_FEATURES, PARAM_GRID, ROLLED, TARGET


def R4(x: str) -> str:
    return f"(ROUND({x}, 4) + 0.0)"


def DEC(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def EX(x: str) -> str:
    return f"CAST({x} AS DECIMAL(27,10))"


GEO = "geo AS (SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"

PANEL = f"""
panel0 AS (
  SELECT r_name AS region, CAST(n_regionkey AS VARCHAR) AS respondent,
         CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS period,
         CAST(sum({DEC('l_quantity')}) AS DOUBLE) AS demand,
         CAST(sum({DEC('l_quantity')} * (1 + {DEC('l_tax')})) AS DOUBLE) AS da_forecast,
         CAST(sum({DEC('l_extendedprice')} * (1 - {DEC('l_discount')})) AS DOUBLE) / 1000.0 AS net_generation,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN {DEC('l_quantity')} END) AS DOUBLE) AS solar,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN {DEC('l_quantity')} END) AS DOUBLE) AS wind
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN geo ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
panel AS (
  SELECT period, respondent, region AS respondent_name, region, demand, da_forecast, net_generation,
         net_generation - demand AS total_interchange, solar, wind
  FROM panel0)"""

WEATHER = f"""
weather0 AS (
  SELECT r_name AS region, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS datetime,
         CAST(sum({DEC('o_totalprice')}) AS DOUBLE) / CAST(count(o_totalprice) AS DOUBLE) / 1000.0 AS allsky_sfc_sw_dwn,
         CAST(count(*) AS DOUBLE) AS t2m,
         CAST(sum({DEC('c_acctbal')}) AS DOUBLE) / CAST(count(c_acctbal) AS DOUBLE) / 100.0 AS wsc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey
  GROUP BY 1, 2),
wx AS (
  SELECT CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS mo,
         CAST(day(datetime) AS INTEGER) AS dy, CAST(hour(datetime) AS INTEGER) AS hr,
         allsky_sfc_sw_dwn, t2m, wsc, region, datetime
  FROM weather0)"""

JOINED = """
joined AS (
  SELECT p.*, w.year, w.mo, w.dy, w.hr, w.allsky_sfc_sw_dwn, w.t2m, w.wsc, w.datetime
  FROM panel p JOIN wx w ON p.region = w.region AND p.period = w.datetime)"""

CALENDAR = """
calendar AS (
  SELECT *, CAST(dayofyear(period) AS INTEGER) AS day_of_year,
         CAST(isodow(period) - 1 AS INTEGER) AS day_of_week,
         CAST(CASE WHEN isodow(period) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
  FROM joined)"""

SHARES = """
shares AS (
  SELECT * REPLACE (coalesce(solar, 0.0) AS solar, coalesce(wind, 0.0) AS wind),
         coalesce(coalesce(solar, 0.0) / nullif(net_generation, 0.0) * 100.0, 0.0) AS pct_solar,
         coalesce(coalesce(wind, 0.0) / nullif(net_generation, 0.0) * 100.0, 0.0) AS pct_wind
  FROM calendar)"""

LAGS = f"""
lags AS (
  SELECT *,
         lag(da_forecast, 24) OVER w AS da_forecast_yesterday,
         lag(total_interchange, 1) OVER w AS lag_interchange_1h,
         lag(total_interchange, 24) OVER w AS lag_interchange_24h,
         CASE WHEN count(total_interchange) OVER w3 = 3
              THEN CAST(sum({EX('total_interchange')}) OVER w3 AS DOUBLE) / 3.0 END AS interchange_roll_mean_3h,
         lag(net_generation, 1) OVER w AS net_generation_lag_1,
         demand - lag(da_forecast, 24) OVER w AS unexpect_dem_diff
  FROM shares
  WINDOW w AS (PARTITION BY region ORDER BY period),
         w3 AS (PARTITION BY region ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""

LAG_OUT = [
    "period", "respondent", "respondent_name", "region", "demand", "da_forecast", "net_generation",
    "total_interchange", "solar", "wind", "year", "mo", "dy", "hr", "allsky_sfc_sw_dwn", "t2m", "wsc",
    "datetime", "day_of_year", "day_of_week", "is_weekend", "pct_solar", "pct_wind",
    "da_forecast_yesterday", "lag_interchange_1h", "lag_interchange_24h", "interchange_roll_mean_3h",
    "net_generation_lag_1", "unexpect_dem_diff",
]


def _not_null(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


COMPLETE = f"""
complete AS (SELECT * FROM lags WHERE {_not_null(LAG_OUT)})"""

ROLLED_CTE = (
    "\nrolled AS (\n  SELECT *,\n"
    + ",\n".join(
        f"         CAST(sum({EX(c)}) OVER w720 AS DOUBLE) / count({c}) OVER w720 AS {c}_30d_avg" for c in ROLLED
    )
    + "\n  FROM complete\n  WINDOW w720 AS (PARTITION BY region ORDER BY period ROWS BETWEEN 719 PRECEDING AND CURRENT ROW))"
)

FINAL = f"""
final AS (SELECT {', '.join(FEATURE_TABLE)} FROM rolled WHERE {_not_null(FEATURE_TABLE)})"""

FEATURE_CTES = ",".join([GEO, PANEL, WEATHER, JOINED, CALENDAR, SHARES, LAGS, COMPLETE, ROLLED_CTE, FINAL])


def _features(select: str) -> str:
    return f"WITH {FEATURE_CTES}\n{select}"


SPLIT = f"""
split AS (SELECT *, period >= TIMESTAMP '{TEST_SPLIT}' AS is_test FROM final)"""


def _trees_sql() -> str:
    """SHORT_MODEL grown in SQL: a table of bins, then a table of cuts for each level of each tree."""
    xs = ", ".join(f"CAST({c} AS DOUBLE)" for c in MODEL_FEATURES)
    names = ", ".join(f"'{c}'" for c in MODEL_FEATURES)
    rate = f"CAST({SHORT_MODEL['learning_rate']} AS DOUBLE)"
    one = "CAST(1 AS DOUBLE)"
    whole = "CAST(round_even({}, 0) AS BIGINT)".format
    out = [f"""
rowsx AS (SELECT region, period, is_test, {TARGET} AS y, [{xs}] AS xs FROM split),
long AS (SELECT region, period, is_test, unnest(xs) AS x, unnest(range({len(MODEL_FEATURES)})) AS f FROM rowsx),
span AS (SELECT region, f, min(x) AS lo, max(x) AS hi FROM long WHERE NOT is_test GROUP BY ALL),
fine AS (
  SELECT region, f, CAST(least(floor(CASE WHEN hi = lo THEN 0 ELSE (x - lo) / (hi - lo) * {CELLS} END), {CELLS - 1}) AS INTEGER) AS cell, count(*) AS c, min(x) AS x
  FROM long JOIN span USING (region, f) WHERE NOT is_test GROUP BY ALL),
part AS (
  SELECT *, ((sum(c) OVER (PARTITION BY region, f ORDER BY cell) - c) * {BINS}) // sum(c) OVER (PARTITION BY region, f) AS b FROM fine),
edges AS (SELECT region, f, row_number() OVER (PARTITION BY region, f ORDER BY b) - 1 AS k, x FROM (SELECT region, f, b, min(x) AS x FROM part GROUP BY ALL)),
binned AS (SELECT l.region, l.period, l.is_test, l.f, coalesce(e.k, 0) AS k FROM long l ASOF LEFT JOIN edges e ON l.region = e.region AND l.f = e.f AND l.x >= e.x),
unit AS (SELECT region, power(2, {BITS} - (CAST(floor(log2(max(abs(y)))) AS INTEGER) + 1)) AS s FROM rowsx WHERE NOT is_test GROUP BY 1),
base AS (SELECT region, any_value(s) AS s, CAST(sum({whole('y * s')}) AS DOUBLE) / any_value(s) / count(*) AS base FROM rowsx JOIN unit USING (region) WHERE NOT is_test GROUP BY 1),
now0 AS (SELECT region, period, is_test, y, s, base AS now FROM rowsx JOIN base USING (region))"""]
    nodes = []
    for t in range(SHORT_MODEL["n_estimators"]):
        out.append(f"st{t}_0 AS (SELECT region, period, is_test, s, {whole('(y - now) * s')} AS r, 0 AS node FROM now{t})")
        for level in range(SHORT_MODEL["max_depth"]):
            at = f"{t}_{level}"
            out.append(f"""
h{at} AS (SELECT s.region, s.node, b.f, b.k, count(*) AS n, sum(s.r) AS g, any_value(s.s) AS s FROM st{at} s JOIN binned b USING (region, period) WHERE NOT s.is_test AND s.node >= {2**level - 1} GROUP BY ALL),
c{at} AS (
  SELECT region, node, f, k, s, CAST(sum(n) OVER w AS BIGINT) AS nl, CAST(sum(g) OVER w AS DOUBLE) AS gl, CAST(sum(n) OVER p AS BIGINT) AS nt, CAST(sum(g) OVER p AS DOUBLE) AS gt
  FROM h{at} WINDOW w AS (PARTITION BY region, node, f ORDER BY k), p AS (PARTITION BY region, node, f)),
g{at} AS (
  SELECT *, 0.5 * (gl * gl / (nl + {one}) + (gt - gl) * (gt - gl) / (nt - nl + {one}) - gt * gt / (nt + {one})) / s / s AS gain FROM c{at} WHERE nl < nt),
b{at} AS (
  SELECT g.*, e.x AS threshold FROM (SELECT * FROM g{at} WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY region, node ORDER BY gain DESC, f, k) = 1) g
  JOIN edges e ON e.region = g.region AND e.f = g.f AND e.k = g.k + 1),
st{t}_{level + 1} AS (
  SELECT s.region, s.period, s.is_test, s.s, s.r, CASE WHEN c.f IS NULL THEN s.node WHEN b.k <= c.k THEN 2 * s.node + 1 ELSE 2 * s.node + 2 END AS node
  FROM st{at} s LEFT JOIN b{at} c ON c.region = s.region AND c.node = s.node LEFT JOIN binned b ON b.region = s.region AND b.period = s.period AND b.f = c.f)""")
            nodes.append(f"SELECT region, {t} AS tree, node, [{names}][f + 1] AS feature, threshold, gain, nt AS cover, CAST(NULL AS DOUBLE) AS value FROM b{at}")
        last = f"{t}_{SHORT_MODEL['max_depth']}"
        out.append(f"""
leaf{t} AS (SELECT region, node, count(*) AS cover, {rate} * (CAST(sum(r) AS DOUBLE) / any_value(s) / (count(*) + {one})) AS value FROM st{last} WHERE NOT is_test GROUP BY ALL),
now{t + 1} AS (SELECT n.region, n.period, n.is_test, n.y, n.s, n.now + l.value AS now FROM now{t} n JOIN st{last} USING (region, period) JOIN leaf{t} l ON l.region = n.region AND l.node = st{last}.node)""")
        nodes.append(f"SELECT region, {t}, node, NULL, NULL, NULL, cover, value FROM leaf{t}")
    out.append("nodes AS (" + "\nUNION ALL ".join(nodes) + ")")
    return ",".join(out)


def _corr_sql() -> str:
    cols = CORR_COLS
    stats = []
    for i, c in enumerate(cols):
        stats.append(f"stddev_pop({c}) AS sd_{i}")
    # corr works on the rows where both are present; a constant column gives NaN
    for i, j in combinations(range(len(cols)), 2):
        stats.append(f"corr({cols[i]}, {cols[j]}) AS r_{i}_{j}")
    unions = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            expr = f"sd_{i} / nullif(sd_{i}, 0.0)"
            if i != j:
                a, bb = min(i, j), max(i, j)
                expr = f"CASE WHEN isfinite(r_{a}_{bb}) THEN r_{a}_{bb} END"
            unions.append(f"SELECT region, '{cols[i]}' AS feature_1, '{cols[j]}' AS feature_2, {R4(expr)} AS corr FROM cstats")
    return (
        f"cstats AS (SELECT region, {', '.join(stats)} FROM complete GROUP BY region),\n"
        f"corrm AS ({' UNION ALL '.join(unions)})"
    )


CORR = _corr_sql()

STATS = (
    "stats AS (SELECT region, "
    + ", ".join(
        f"avg({c}) AS {c}__mean, CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) = 0 THEN 1.0 "
        f"ELSE stddev_pop({c}) END AS {c}__scale"
        for c in MODEL_FEATURES
    )
    + " FROM split WHERE NOT is_test GROUP BY region)"
)
SCALED = (
    "scaled AS (SELECT s.region, s.period, s.is_test, s.total_interchange, "
    + ", ".join(f"(s.{c} - t.{c}__mean) / t.{c}__scale AS {c}" for c in MODEL_FEATURES)
    + " FROM split s JOIN stats t ON s.region = t.region)"
)

NAIVE = """
naive AS (SELECT region, period, is_test, total_interchange AS y, lag_interchange_1h AS y_hat FROM split)"""


def _metrics(src: str, keys: str) -> str:
    e = "(y_hat - y)"
    return (
        f"SELECT {keys}, count(*) AS n, {R4(f'sqrt(avg({e} * {e}))')} AS rmse, {R4(f'avg(abs({e}))')} AS mae, "
        f"{R4(f'avg(CASE WHEN y <> 0 THEN abs({e} / y) END) * 100.0')} AS mape, "
        f"{R4(f'CASE WHEN var_pop(y) * count(y) = 0 THEN (CASE WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - sum({e} * {e}) / (var_pop(y) * count(y)) END')} AS r2 "
        f"FROM {src} GROUP BY {keys}"
    )


FOLDS_SQL = """
fidx AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY period) - 1 AS i,
                count(*) OVER (PARTITION BY region) AS n FROM {src}),
{name} AS (SELECT *, CAST(CASE WHEN n // 5 <= 0 THEN NULL
                          WHEN i < n - 4 * (n // 5) THEN 0
                          ELSE 1 + (i - (n - 4 * (n // 5))) // (n // 5) END AS INTEGER) AS fold FROM fidx)"""

GRID_VALUES = ", ".join(f"({i}, {f!r}, 'factor={f!r}')" for i, f in enumerate(FACTOR_GRID))
BEST = f"""
pgrid AS (SELECT * FROM (VALUES {GRID_VALUES}) g(param_order, factor, params)),
fscores AS (SELECT region, params, param_order, fold,
                   CAST(sum(CAST(abs(demand - da_forecast * CAST(factor AS DOUBLE)) AS DECIMAL(27,10))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mae
            FROM pfold, pgrid WHERE fold >= 1 GROUP BY region, params, param_order, fold),
pmean AS (SELECT region, param_order, params, CAST(sum(CAST(mae AS DECIMAL(27,10))) AS DOUBLE) / CAST(count(mae) AS DOUBLE) AS mean_score FROM fscores GROUP BY 1, 2, 3),
best AS (SELECT region, params AS best_params, param_order AS best_param_order, mean_score AS best_score0
         FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mean_score, param_order) AS rk FROM pmean) q
         WHERE rk = 1)"""

PAGE_TEXT = """
rtext AS (
  SELECT CASE WHEN event_id % 17 = 1 THEN '2024-13-45T99'
              WHEN event_id % 2 = 0 THEN strftime(date_trunc('hour', ts), '%Y-%m-%dT%H')
              ELSE strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') END AS period,
         'R' || CAST(user_id % 5 AS VARCHAR) AS respondent,
         'Respondent ' || CAST(user_id % 5 AS VARCHAR) AS respondent_name,
         upper(substr(event_type, 1, 2)) AS type, event_type AS type_name,
         CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
         'count' AS value_units, event_id AS ordinal
  FROM events)"""

READINGS = """
rd AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period,
         'R' || CAST(user_id % 5 AS VARCHAR) AS respondent,
         'Respondent ' || CAST(user_id % 5 AS VARCHAR) AS respondent_name,
         upper(substr(event_type, 1, 2)) AS type, event_type AS type_name, value,
         'count' AS value_units, event_id AS ordinal
  FROM events)"""

PARSED = """
parsed AS (
  SELECT CAST(coalesce(try_strptime(period, '%Y-%m-%dT%H'), try_strptime(period, '%Y-%m-%d %H:%M:%S')) AS TIMESTAMP) AS period,
         respondent, respondent_name, type, type_name, TRY_CAST(value AS DOUBLE) AS value, value_units, ordinal
  FROM rtext)"""


def _pivot(src: str, types, name: str) -> str:
    cols = ", ".join(f"arg_min(value, ordinal) FILTER (WHERE type_name = '{t}') AS {t}" for t in types)
    lst = ", ".join(f"'{t}'" for t in types)
    return (
        f"{name} AS (SELECT period, respondent, respondent_name, {cols} FROM {src} "
        f"WHERE value IS NOT NULL AND period IS NOT NULL AND respondent IS NOT NULL AND respondent_name IS NOT NULL "
        f"AND type_name IN ({lst}) GROUP BY period, respondent, respondent_name)"
    )


SITE_ROWS = """
srows AS (
  SELECT n_regionkey AS table_no, CAST(n_nationkey AS BIGINT) * 1000000000000 + s_suppkey * 2 + 1 AS row_no,
         CASE WHEN s_suppkey % 3 = 0 THEN s_name || '[1]' ELSE s_name END AS city,
         'Field ' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 4 = 0 THEN ' [a] ' ELSE '' END AS airport,
         'F' || CAST(s_suppkey AS VARCHAR) AS faa,
         CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_name END AS iata,
         'K' || CAST(s_suppkey AS VARCHAR) AS icao,
         CASE WHEN s_suppkey % 11 = 0 THEN ''
              WHEN s_suppkey % 5 = 0 THEN CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS VARCHAR) || '.0'
              ELSE format('{:,}', CAST(floor(abs(s_acctbal) * 100) AS BIGINT)) END AS enplanements
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT n_regionkey, CAST(n_nationkey AS BIGINT) * 1000000000000, upper(n_name), NULL, NULL, NULL, NULL, NULL
  FROM nation),
shdr AS (
  SELECT *, coalesce(city = upper(city) AND regexp_matches(city, '[A-Za-z]') AND airport IS NULL, false) AS is_hdr
  FROM srows),
filled AS (
  SELECT table_no, row_no,
         last_value(CASE WHEN is_hdr THEN city END IGNORE NULLS)
           OVER (ORDER BY table_no, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state,
         city, airport, faa, iata, icao, enplanements, is_hdr
  FROM shdr),
filled2 AS (SELECT table_no, row_no, state, city, airport, faa, iata, icao, enplanements FROM filled WHERE NOT is_hdr),
cleaned AS (
  SELECT table_no, row_no,
         array_to_string(list_transform(string_split(lower(state), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS state,
         trim(regexp_replace(city, '\\[.*?\\]', '', 'g')) AS city,
         trim(regexp_replace(airport, '\\[.*?\\]', '', 'g')) AS airport,
         faa, iata, icao,
         TRY_CAST(nullif(regexp_replace(regexp_replace(enplanements, '\\.0$', ''), '\\D', '', 'g'), '') AS DOUBLE) AS enplanements
  FROM filled2),
coords AS (
  SELECT upper(lower(s_name)) AS iata_code,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal / 111.0 END AS latitude_deg,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey * CAST(-3.3333333 AS DOUBLE) END AS longitude_deg
  FROM supplier),
withc AS (
  SELECT c.table_no, c.row_no, c.state, c.city, c.airport, c.iata, c.enplanements,
         round(k.latitude_deg, 4) AS latitude_deg, round(k.longitude_deg, 4) AS longitude_deg
  FROM cleaned c LEFT JOIN coords k ON c.iata = k.iata_code),
rmap AS (SELECT array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS state,
                r_name AS region FROM geo)"""


def _site_first(c: str) -> str:
    return f"arg_min({c}, rk) FILTER (WHERE {c} IS NOT NULL) AS {c}"


SITE_PICK = f"""
mapped AS (
  SELECT w.*, m.region FROM withc w LEFT JOIN rmap m ON w.state = m.state
  WHERE w.iata IS DISTINCT FROM 'EWR'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY enplanements IS NULL, enplanements DESC,
                                                        iata ASC NULLS FIRST, table_no, row_no) AS rk
  FROM mapped WHERE region IS NOT NULL)"""

LONGLINES = ", ".join(["state", "city", "airport", "iata", "enplanements", "latitude_deg", "longitude_deg"])


def _imp_sql() -> str:
    return f"""
imp AS (SELECT region, feature_2 AS feature, abs(corr) AS importance FROM corrm
        WHERE feature_1 = 'total_interchange' AND feature_2 <> 'total_interchange' AND corr IS NOT NULL),
pf AS (SELECT feature, max(importance) AS mx, sum(importance) AS sm FROM imp GROUP BY feature),
pf2 AS (SELECT feature, mx, sm / (nullif(mx, 0.0) * (SELECT count(DISTINCT region) FROM corrm)) AS mean_share FROM pf),
top AS (SELECT feature, mx, mean_share, CAST(row_number() OVER (ORDER BY mean_share DESC, feature ASC) AS INTEGER) AS rank
        FROM pf2 WHERE mean_share IS NOT NULL ORDER BY mean_share DESC, feature ASC LIMIT 10)"""


def oracle_sql() -> dict[str, str]:
    sel_lags = ", ".join(LAG_OUT)
    q: dict[str, str] = {}
    q["energy_weather"] = _features("SELECT * FROM joined")
    q["calendar_features"] = _features("SELECT * FROM calendar")
    q["share_features"] = _features("SELECT * FROM shares")
    q["lag_features"] = _features(f"SELECT {sel_lags} FROM lags")
    q["dropna_any"] = _features(f"SELECT {sel_lags} FROM complete")
    q["rolling_30d"] = _features("SELECT * FROM rolled")
    q["feature_table"] = _features("SELECT * FROM final")
    q["corr_matrix"] = f"WITH {FEATURE_CTES},\n{CORR}\nSELECT * FROM corrm"
    q["scatter_extract"] = _features(
        "SELECT region, period, demand, demand_30d_avg, allsky_sfc_sw_dwn, solar, wsc, wind, t2m FROM rolled"
    )
    q["time_split"] = f"WITH {FEATURE_CTES},{SPLIT}\nSELECT region, period, total_interchange, is_test FROM split"
    q["expanding_folds"] = (
        f"WITH {FEATURE_CTES},{SPLIT},"
        + FOLDS_SQL.format(src="(SELECT * FROM split WHERE NOT is_test)", name="folded")
        + "\nSELECT region, period, fold FROM folded"
    )
    q["standardise"] = (
        f"WITH {FEATURE_CTES},{SPLIT},\n{STATS},\n{SCALED}\n"
        f"SELECT region, period, is_test, {', '.join(R4(c) + ' AS ' + c for c in MODEL_FEATURES)} FROM scaled"
    )
    q["scale_inverse"] = f"WITH {FEATURE_CTES},{SPLIT}\nSELECT region, period, is_test, {', '.join(R4(f'CAST({c} AS DOUBLE) + CAST({OFF_TIES} AS DOUBLE)') + f' AS {c}' for c in MODEL_FEATURES)} FROM split"
    elem_sum = " + ".join(f"p.{c}" for c in MODEL_FEATURES)
    q["sequence_24"] = (
        f"WITH {FEATURE_CTES},{SPLIT},\n{STATS},\n{SCALED},\n"
        "sq AS (SELECT *, row_number() OVER (PARTITION BY region, is_test ORDER BY period) AS i FROM scaled)\n"
        f"SELECT c.region, c.is_test, c.period, CAST(count(*) AS INTEGER) AS n_steps, {R4(f'sum({elem_sum})')} AS seq_sum, "
        f"{R4(f'sum((p.i - c.i + 25) * ({elem_sum}))')} AS seq_weighted, "
        f"{R4(f'sum(CASE WHEN p.i = c.i - 24 THEN {elem_sum} END)')} AS first_step, "
        f"{R4(f'sum(CASE WHEN p.i = c.i - 1 THEN {elem_sum} END)')} AS last_step, "
        "c.total_interchange AS y\n"
        "FROM sq c JOIN sq p ON c.region = p.region AND c.is_test = p.is_test AND p.i BETWEEN c.i - 24 AND c.i - 1\n"
        "WHERE c.i > 24 GROUP BY c.region, c.is_test, c.period, c.total_interchange"
    )
    q["error_metrics"] = f"WITH {FEATURE_CTES},{SPLIT},{NAIVE}\n" + _metrics("naive", "region, is_test")
    q["scaled_scores"] = f"SELECT region, is_test, n, rmse, mae, r2 FROM ({q['error_metrics']})"
    pfold = FOLDS_SQL.format(src="panel", name="pfold")
    q["best_params"] = (
        f"WITH {GEO},{PANEL},{pfold},{BEST}\n"
        "SELECT region, best_params, best_param_order, best_score0 AS best_score FROM best"
    )
    q["region_results"] = (
        f"WITH {FEATURE_CTES},{SPLIT},{NAIVE},{pfold.replace('fidx', 'pidx')},{BEST},\n"
        f"m AS ({_metrics('(SELECT * FROM naive WHERE NOT is_test)', 'region')})\n"
        "SELECT m.*, b.best_params, b.best_param_order, b.best_score0 AS best_score "
        "FROM m LEFT JOIN best b ON m.region = b.region"
    )
    q["importance_rank"] = (
        f"WITH {FEATURE_CTES},\n{CORR},{_imp_sql()}\n"
        f"SELECT t.rank, t.feature, r.region, coalesce(i.importance, 0.0) AS importance, {R4('coalesce(i.importance, 0.0) / t.mx')} AS share, "
        f"{R4('t.mean_share')} AS mean_share FROM top t CROSS JOIN (SELECT DISTINCT region FROM corrm) r "
        "LEFT JOIN imp i ON i.feature = t.feature AND i.region = r.region"
    )
    q["reading_parse"] = f"WITH {PAGE_TEXT},{PARSED}\nSELECT * FROM parsed"
    q["reading_pivot"] = f"WITH {READINGS},{_pivot('rd', ['signup', 'purchase', 'error'], 'pv')}\nSELECT * FROM pv"
    q["energy_outer"] = (
        f"WITH {PAGE_TEXT},{PARSED},{_pivot('parsed', ['signup', 'purchase', 'error'], 'pb')},"
        f"{_pivot('parsed', ['click', 'view'], 'pfu')}\n"
        "SELECT coalesce(pb.period, pfu.period) AS period, coalesce(pb.respondent, pfu.respondent) AS respondent, "
        "coalesce(pb.respondent_name, pfu.respondent_name) AS respondent_name, "
        "coalesce(pb.respondent, pfu.respondent) AS region, pb.signup, pb.purchase, pb.error, pfu.click, pfu.view "
        "FROM pb FULL OUTER JOIN pfu ON pb.period = pfu.period AND pb.respondent = pfu.respondent "
        "AND pb.respondent_name = pfu.respondent_name"
    )
    q["energy_pages"] = q["energy_outer"]
    q["page_completeness"] = (
        f"WITH {PAGE_TEXT}\nSELECT respondent, count(*) AS rows, count(*) AS total, true AS complete FROM rtext GROUP BY respondent"
    )
    eda = ", ".join(f"CAST(sum({EX(v)}) AS DOUBLE) / CAST(count({v}) AS DOUBLE) AS avg_{v}" for v in ["demand", "wind", "solar"])
    q["eda_hour_month"] = _features(f"SELECT region, hr, mo, {eda} FROM rolled GROUP BY 1, 2, 3")
    months = ", ".join(
        f"CAST(sum({EX(f'CASE WHEN mo = {m} THEN demand END')}) AS DOUBLE) / "
        f"nullif(CAST(count(CASE WHEN mo = {m} THEN demand END) AS DOUBLE), 0.0) AS m{m:02d}"
        for m in range(1, 13)
    )
    q["eda_grid"] = _features(f"SELECT region, hr, {months} FROM rolled GROUP BY 1, 2")
    only = ", ".join(f"'{r}'" for r in FILTER_REGIONS)
    q["energy_csv_read"] = (
        f"WITH {GEO},{PANEL}\nSELECT region, period, respondent, respondent_name, demand, da_forecast, net_generation, "
        f"total_interchange, solar, wind FROM panel WHERE region IN ({only})"
    )
    q["model_table_read"] = _features(f"SELECT * FROM final WHERE region IN ({only})")
    q["sink_ignore"] = q["feature_table"]
    grid_rows = ", ".join(f"({i}, '{params_text(p)}')" for i, p in enumerate(param_sets(PARAM_GRID)))
    q["gbt_cv"] = (
        f"WITH {FEATURE_CTES},{SPLIT}\nSELECT region, params, CAST(param_order AS INTEGER) AS param_order, CAST(fold AS INTEGER) AS fold, true AS ok "
        f"FROM (SELECT DISTINCT region FROM split WHERE NOT is_test) r, (VALUES {grid_rows}) g(param_order, params), "
        "(VALUES (1), (2), (3), (4)) f(fold)"
    )
    q["gbt_predict"] = (
        f"WITH {FEATURE_CTES},{SPLIT}\nSELECT region, period, is_test, total_interchange AS y, true AS beats_mean FROM split"
    )
    q["split_counts"] = f"WITH {FEATURE_CTES},{SPLIT}\nSELECT DISTINCT region, true AS ok FROM split WHERE NOT is_test"
    trees = f"WITH RECURSIVE {FEATURE_CTES},{SPLIT},{_trees_sql()}"
    q["gbt_nodes"] = (
        f"{trees}\nSELECT n.region, CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, feature, cover, "
        f"{', '.join(R4(c) + ' AS ' + c for c in ('gain', 'value', 'threshold', 'base'))} FROM nodes n JOIN base USING (region)"
    )
    # the same nodes walked by recursion on the raw values
    q["gbt_walk"] = f"""{trees},
walk AS (
  SELECT region, period, tree, 0 AS node FROM rowsx, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT w.region, w.period, w.tree, CASE WHEN r.xs[list_position([{', '.join(f"'{c}'" for c in MODEL_FEATURES)}], n.feature)] < n.threshold THEN 2 * w.node + 1 ELSE 2 * w.node + 2 END
  FROM walk w JOIN nodes n USING (region, tree, node) JOIN rowsx r USING (region, period) WHERE n.feature IS NOT NULL),
told AS (SELECT w.region, w.period, sum(n.value ORDER BY w.tree) AS v FROM walk w JOIN nodes n USING (region, tree, node) WHERE n.feature IS NULL GROUP BY ALL)
SELECT r.region, r.period, r.is_test, r.y, {R4('b.base + t.v')} AS y_hat FROM rowsx r JOIN told t USING (region, period) JOIN base b ON b.region = r.region"""
    gains = f"""
used AS (SELECT region, feature, avg(gain) AS g, count(*) AS splits, CAST(sum(cover) AS BIGINT) AS cover FROM nodes WHERE feature IS NOT NULL GROUP BY ALL),
cells AS (SELECT region, unnest([{', '.join(f"'{c}'" for c in MODEL_FEATURES)}]) AS feature FROM (SELECT DISTINCT region FROM nodes)),
imp AS (SELECT c.region, c.feature, coalesce(g / sum(g) OVER (PARTITION BY c.region), 0) AS importance, coalesce(splits, 0) AS splits, coalesce(cover, 0) AS cover FROM cells c LEFT JOIN used u USING (region, feature))"""
    q["gbt_importance"] = f"{trees},{gains}\nSELECT region, feature, {R4('importance')} AS importance, splits, cover FROM imp"
    q["gbt_importance_rank"] = f"""{trees},{gains},
per AS (SELECT feature, max(importance) AS m, avg(importance) / nullif(max(importance), 0) AS mean_share FROM imp GROUP BY 1),
best AS (SELECT *, row_number() OVER (ORDER BY mean_share DESC, feature) AS rank FROM per WHERE mean_share IS NOT NULL)
SELECT CAST(rank AS INTEGER) AS rank, feature, region, {R4('importance')} AS importance, {R4('importance / m')} AS share, {R4('mean_share')} AS mean_share
FROM best JOIN imp USING (feature) WHERE rank <= 10"""
    kept = f"""{PAGE_TEXT},
pg AS (SELECT respondent, ordinal // 200 AS p, count(*) AS n FROM rtext GROUP BY ALL),
po AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS e, CAST(sum(n) OVER w AS BIGINT) - n AS s, CAST(sum(n) OVER (PARTITION BY respondent) AS BIGINT) AS total FROM pg WINDOW w AS (PARTITION BY respondent ORDER BY p)),
got AS (SELECT * FROM po WHERE p % 5 <> 2)"""
    q["page_gaps"] = f"""WITH {kept}
SELECT respondent, gap_start, s AS gap_end FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY respondent ORDER BY p), 0) AS gap_start FROM got) WHERE s > gap_start
UNION ALL SELECT respondent, max(e), any_value(total) FROM got GROUP BY respondent HAVING max(e) < any_value(total)"""
    q["page_coverage"] = f"WITH {kept}\nSELECT (SELECT any_value(total) FROM po WHERE po.respondent = r.respondent) AS page_total, r.* FROM rtext r SEMI JOIN got g ON g.respondent = r.respondent AND g.p = r.ordinal // 200"
    q["pages_explode"] = (
        f"WITH {PAGE_TEXT}\nSELECT count(*) OVER (PARTITION BY respondent) AS page_total, * FROM rtext"
    )
    q["pages_stream"] = (
        f"WITH {PAGE_TEXT},{PARSED}\nSELECT count(*) OVER (PARTITION BY respondent) AS page_total, * FROM parsed"
    )
    hm = ", ".join(
        f"CAST(sum({EX(v)}) AS DOUBLE) / CAST(count({v}) AS DOUBLE) AS avg_{v}" for v in ["signup", "click", "view"]
    )
    q["hour_month_mean"] = (
        f"WITH {READINGS},{_pivot('rd', ['signup', 'purchase', 'error', 'click', 'view'], 'pv')}\n"
        f"SELECT respondent, CAST(hour(period) AS INTEGER) AS hr, CAST(month(period) AS INTEGER) AS mo, {hm} "
        "FROM pv GROUP BY 1, 2, 3"
    )
    grid = ", ".join(
        f"CAST(sum(CAST(CASE WHEN month(period) = {m} THEN signup END AS DECIMAL(27,10))) AS DOUBLE) / "
        f"nullif(CAST(count(CASE WHEN month(period) = {m} THEN signup END) AS DOUBLE), 0.0) AS m{m:02d}"
        for m in range(1, 13)
    )
    q["hour_month_grid"] = (
        f"WITH {READINGS},{_pivot('rd', ['signup', 'purchase', 'error', 'click', 'view'], 'pv')}\n"
        f"SELECT respondent, CAST(hour(period) AS INTEGER) AS hr, {grid} FROM pv GROUP BY 1, 2"
    )
    q["weather_read"] = f"WITH {GEO},{WEATHER}\nSELECT * FROM wx"
    q["weather_write"] = q["weather_read"]
    q["weather_gaps"] = f"""WITH {GEO},{WEATHER},
have AS (SELECT region, datetime AS t FROM wx WHERE month(datetime) NOT IN (3, 4, 9)),
days AS (SELECT region, unnest(range(min(t), TIMESTAMP '2001-09-01', INTERVAL 1 DAY)) AS t FROM have GROUP BY region),
lack AS (SELECT *, t - INTERVAL 1 DAY * row_number() OVER (PARTITION BY region ORDER BY t) AS island FROM days ANTI JOIN have USING (region, t))
SELECT region, min(t) AS gap_start, max(t) + INTERVAL 1 DAY AS gap_end, count(*) AS n_missing FROM lack GROUP BY region, island"""
    site_ctes = f"WITH {GEO},{SITE_ROWS}"
    q["coords_read"] = f"{site_ctes}\nSELECT lower(iata_code) AS iata_code, latitude_deg, longitude_deg FROM coords"
    q["site_tables_union"] = (
        f"{site_ctes}\nSELECT table_no, row_no, city, airport, faa, iata, CASE WHEN table_no <> 1 THEN icao END AS icao, enplanements FROM srows"
    )
    q["state_ffill"] = f"{site_ctes}\nSELECT * FROM filled2"
    q["text_clean"] = f"{site_ctes}\nSELECT * FROM cleaned"
    q["airport_coords"] = f"{site_ctes}\nSELECT * FROM withc"
    q["region_map"] = (
        f"{site_ctes}\nSELECT c.table_no, c.row_no, c.iata, c.state, m.region FROM cleaned c LEFT JOIN rmap m ON c.state = m.state"
    )
    q["site_excluded"] = (
        f"{site_ctes}\nSELECT table_no, row_no, iata, state, enplanements FROM "
        "(SELECT * REPLACE (CASE WHEN row_no % 7 = 3 THEN 'EWR' ELSE iata END AS iata) FROM cleaned) WHERE iata IS DISTINCT FROM 'EWR'"
    )
    lst = ", ".join(f"'{r}'" for r in FILTER_REGIONS)
    q["region_filter"] = (
        f"{site_ctes}\nSELECT c.table_no, c.row_no, c.iata, c.state, m.region FROM cleaned c JOIN rmap m ON c.state = m.state "
        f"WHERE m.region IN ({lst})"
    )
    q["region_site"] = (
        f"{site_ctes},{SITE_PICK}\nSELECT region, "
        + ", ".join(_site_first(c) for c in LONGLINES.split(", "))
        + " FROM ranked GROUP BY region"
    )
    return q
