"""DuckDB SQL equal to each registered query (the independent correctness oracle).

Written from the definitions (FIXTURES mappings, SURVEY semantics), not from
the Spark plans.  DuckDB's RE2 ``.`` stops only at ``\\n`` like Python's, so
patterns need no flag here; lists are emitted as ';' text.
"""

from __future__ import annotations

from ..functions import vocab


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


RAW = """
raw AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS date,
         CASE WHEN event_type = 'error' THEN CAST(value AS VARCHAR) || 's' ELSE CAST(value AS VARCHAR) END AS temperature,
         json_extract_string(props, '$.k') AS dew_point,
         CAST(user_id % 40 AS VARCHAR) AS wind_speed
  FROM events),
coerced AS (
  SELECT event_id, date, TRY_CAST(temperature AS DOUBLE) AS temperature, TRY_CAST(dew_point AS DOUBLE) AS dew_point,
         TRY_CAST(wind_speed AS DOUBLE) AS wind_speed
  FROM raw)"""

SERIES = RAW + """,
hourly AS (
  SELECT date_trunc('hour', date) AS date,
         arg_max(temperature, (date, event_id, temperature)) FILTER (WHERE temperature IS NOT NULL) AS temperature,
         arg_max(dew_point, (date, event_id, dew_point)) FILTER (WHERE dew_point IS NOT NULL) AS dew_point,
         arg_max(wind_speed, (date, event_id, wind_speed)) FILTER (WHERE wind_speed IS NOT NULL) AS wind_speed
  FROM coerced WHERE date IS NOT NULL GROUP BY 1),
series AS (
  SELECT date, temperature, dew_point, wind_speed,
         CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS idx,
         CAST(count(*) OVER () AS BIGINT) AS n
  FROM hourly WHERE temperature IS NOT NULL AND dew_point IS NOT NULL AND wind_speed IS NOT NULL)"""

PANEL = """
panel0 AS (
  SELECT l_suppkey, date_trunc('day', l_shipdate) AS date,
         arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)) AS l_quantity,
         arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS l_extendedprice,
         arg_max(l_discount, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_discount)) AS l_discount
  FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2),
panel AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY date) - 1 AS BIGINT) AS idx
  FROM panel0 WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL)"""

CASES = """
cases AS (
  SELECT CAST(o_orderkey AS BIGINT) AS case_id,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS request_time,
         strftime(o_orderdate + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS forecast_target_time,
         CAST(o_totalprice AS DOUBLE) AS p_t, (o_custkey % 1000) / 10.0 AS p_d, (o_orderkey % 300) / 10.0 AS p_w,
         CAST(250000.0 AS DOUBLE) AS a_t, (o_custkey % 970) / 10.0 AS a_d, (o_orderkey % 290) / 10.0 AS a_w,
         o_orderstatus, o_orderpriority
  FROM orders)"""


def _v2(t, x, y, z) -> str:
    return (f"'The forecast target time is ' || {t} || '. The predicted temperature is ' || {x} || "
            f"'°F. The predicted dew point is ' || {y} || '°F. The predicted wind speed is ' || {z} || ' mph.'")


def _s(x) -> str:
    return f"CAST({x} AS VARCHAR)"


T, X, Y, Z = "forecast_target_time", _s("p_t"), _s("p_d"), _s("p_w")

SINGLE_TEXT = f"""CASE case_id % 10
  WHEN 0 THEN {_v2(T, X, Y, Z)}
  WHEN 1 THEN 'For the 24-hour forecast target time ' || {T} || ', the predicted temperature is ' || {X} || ', the predicted dew point is ' || {Y} || ', and the predicted wind speed is ' || {Z} || '.'
  WHEN 2 THEN {_v2(T, _s("round(p_t + 1.0, 2)"), Y, Z)}
  WHEN 3 THEN 'The forecast target time is ' || {T} || '. The predicted temperature is ' || {X} || '°F. The predicted dew point is ' || {Y} || '°F.'
  WHEN 4 THEN {_v2("replace(" + T + ", ' ', 'T')", X, Y, Z)}
  WHEN 5 THEN {_v2("replace(" + T + ", ' ', '  ')", X, Y, Z)}
  WHEN 6 THEN {_v2(T, X, Y, Z)} || ' Expect rain and humidity.'
  WHEN 7 THEN 'At ' || {T} || ': ' || {X} || ', ' || {Y} || ', ' || {Z}
  WHEN 8 THEN 'forecast_target_time: ' || {T} || chr(10) || 'predicted_temperature: ' || {X} || chr(10) || 'predicted_dew_point: ' || {Y} || chr(10) || 'predicted_wind_speed: ' || {Z} || chr(10) || 'absolute_error: not reported'
  ELSE 'The forecast target time is ' || {T} || '. The predicted temperature is' || chr(10) || {X} || '°F. The predicted dew point is' || chr(10) || {_s("round(p_d + 0.05, 2)")} || '°F. The predicted wind speed is' || chr(10) || {Z} || ' mph.'
END"""

RESPONSES = CASES + f""",
responses AS (
  SELECT case_id, 'agentic' AS system, request_time, forecast_target_time, p_t, p_d, p_w,
         {_v2(T, X, Y, Z)} AS response
  FROM cases
  UNION ALL
  SELECT case_id, 'single_tool' AS system, request_time, forecast_target_time, p_t, p_d, p_w,
         {SINGLE_TEXT} AS response
  FROM cases)"""

NUM = r"-?\d+(?:\.\d+)?"
DT = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"


def _label_expr(text: str, labels) -> str:
    tries = []
    for lab in labels:
        near = vocab.NEAR_TEMPLATE.format(label=lab)
        far = vocab.FAR_TEMPLATE.format(label=lab)
        tries.append(f"TRY_CAST(NULLIF(regexp_extract({text}, '{near}', 1), '') AS DOUBLE)")
        tries.append(f"TRY_CAST(NULLIF(regexp_extract({text}, '{far}', 1), '') AS DOUBLE)")
    return "COALESCE(" + ", ".join(tries) + ")"


EXTRACT = RESPONSES + f""",
ex0 AS (
  SELECT *, replace(lower(response), '_', ' ') AS norm, NULLIF(regexp_extract(response, '{DT}', 0), '') AS obs_time
  FROM responses),
ex1 AS (
  SELECT *,
    {_label_expr('norm', vocab.LABELS['predicted_temperature'])} AS l_t,
    {_label_expr('norm', vocab.LABELS['predicted_dew_point'])} AS l_d,
    {_label_expr('norm', vocab.LABELS['predicted_wind_speed'])} AS l_w,
    list_transform(regexp_extract_all(
        CASE WHEN obs_time IS NOT NULL AND strpos(response, obs_time) > 0
             THEN substr(response, strpos(response, obs_time) + length(obs_time)) ELSE response END,
        '{NUM}'), lambda s: TRY_CAST(s AS DOUBLE)) AS nums
  FROM ex0),
extracted AS (
  SELECT *,
    CASE WHEN (l_t IS NULL OR l_d IS NULL OR l_w IS NULL) AND len(nums) >= 3 THEN COALESCE(l_t, nums[1]) ELSE l_t END AS obs_t,
    CASE WHEN (l_t IS NULL OR l_d IS NULL OR l_w IS NULL) AND len(nums) >= 3 THEN COALESCE(l_d, nums[2]) ELSE l_d END AS obs_d,
    CASE WHEN (l_t IS NULL OR l_d IS NULL OR l_w IS NULL) AND len(nums) >= 3 THEN COALESCE(l_w, nums[3]) ELSE l_w END AS obs_w
  FROM ex1)"""


def _terms(text: str, terms) -> str:
    return f"array_to_string(list_filter({_sql_list(terms)}, lambda t: contains({text}, t)), ';')"


def _score_common(rounded: bool) -> str:
    e = (lambda c: f"round({c}, 2)") if rounded else (lambda c: c)
    return f"""
scored0 AS (
  SELECT *, {e('p_t')} AS e_t, {e('p_d')} AS e_d, {e('p_w')} AS e_w FROM extracted),
scored1 AS (
  SELECT *,
    COALESCE(obs_time = forecast_target_time, FALSE) AS target_time_match,
    COALESCE(abs(e_t - obs_t) <= 0.05, FALSE) AS temperature_match,
    COALESCE(abs(e_d - obs_d) <= 0.05, FALSE) AS dew_point_match,
    COALESCE(abs(e_w - obs_w) <= 0.05, FALSE) AS wind_speed_match
  FROM scored0),
scored AS (
  SELECT *,
    concat_ws(';', CASE WHEN obs_time IS NULL THEN 'forecast_target_time' END,
                   CASE WHEN obs_t IS NULL THEN 'predicted_temperature' END,
                   CASE WHEN obs_d IS NULL THEN 'predicted_dew_point' END,
                   CASE WHEN obs_w IS NULL THEN 'predicted_wind_speed' END) AS missing_fields,
    concat_ws(';', CASE WHEN obs_time IS NOT NULL AND NOT target_time_match THEN 'forecast_target_time' END,
                   CASE WHEN obs_t IS NOT NULL AND NOT temperature_match THEN 'predicted_temperature' END,
                   CASE WHEN obs_d IS NOT NULL AND NOT dew_point_match THEN 'predicted_dew_point' END,
                   CASE WHEN obs_w IS NOT NULL AND NOT wind_speed_match THEN 'predicted_wind_speed' END) AS mismatch_fields
  FROM scored1)"""


SCORE_V2 = EXTRACT + "," + _score_common(True) + f""",
v2 AS (
  SELECT case_id, system, request_time, forecast_target_time AS forecast_target_time_expected,
    obs_time AS forecast_target_time_observed, target_time_match,
    e_t AS expected_temperature, obs_t AS observed_temperature, temperature_match,
    e_d AS expected_dew_point, obs_d AS observed_dew_point, dew_point_match,
    e_w AS expected_wind_speed, obs_w AS observed_wind_speed, wind_speed_match,
    missing_fields, mismatch_fields, {_terms('lower(response)', vocab.TERMS_V2)} AS unsupported_terms,
    (missing_fields <> '' OR mismatch_fields <> '') AS value_hallucinated,
    {_terms('lower(response)', vocab.TERMS_V2)} <> '' AS policy_violation,
    response AS llm_response
  FROM scored)"""

SCORE_SINGLE = EXTRACT + "," + _score_common(False) + f""",
single AS (
  SELECT case_id, system, request_time, forecast_target_time AS forecast_target_time_expected,
    obs_time AS forecast_target_time_observed, target_time_match,
    e_t AS expected_temperature, obs_t AS observed_temperature, temperature_match,
    e_d AS expected_dew_point, obs_d AS observed_dew_point, dew_point_match,
    e_w AS expected_wind_speed, obs_w AS observed_wind_speed, wind_speed_match,
    missing_fields, mismatch_fields, {_terms("replace(lower(response), '_', ' ')", vocab.TERMS_SINGLE)} AS extra_terms,
    (missing_fields <> '' OR mismatch_fields <> '') AS value_hallucinated,
    {_terms("replace(lower(response), '_', ' ')", vocab.TERMS_SINGLE)} <> '' AS policy_violation,
    response AS llm_response
  FROM scored)"""

SCORE_V1 = RESPONSES + f""",
v1a AS (
  SELECT *, round(p_t, 2) AS e_t, round(p_d, 2) AS e_d, round(p_w, 2) AS e_w,
    list_transform(regexp_extract_all(response, '{NUM}'), lambda s: round(CAST(s AS DOUBLE), 2)) AS nums
  FROM responses),
v1b AS (
  SELECT *,
    COALESCE(contains(response, forecast_target_time), FALSE) AS target_time_match,
    COALESCE(len(list_filter(nums, lambda n: abs(n - e_t) <= 0.01)) > 0, FALSE) AS temperature_match,
    COALESCE(len(list_filter(nums, lambda n: abs(n - e_d) <= 0.01)) > 0, FALSE) AS dew_point_match,
    COALESCE(len(list_filter(nums, lambda n: abs(n - e_w) <= 0.01)) > 0, FALSE) AS wind_speed_match,
    {_terms('lower(response)', vocab.TERMS_V1)} AS unsupported_terms
  FROM v1a),
v1 AS (
  SELECT case_id, system, request_time, forecast_target_time AS forecast_target_time_expected, target_time_match,
    e_t AS expected_temperature, temperature_match, e_d AS expected_dew_point, dew_point_match,
    e_w AS expected_wind_speed, wind_speed_match,
    concat_ws(';', CASE WHEN NOT target_time_match THEN 'forecast_target_time' END,
                   CASE WHEN NOT temperature_match THEN 'temperature' END,
                   CASE WHEN NOT dew_point_match THEN 'dew_point' END,
                   CASE WHEN NOT wind_speed_match THEN 'wind_speed' END) AS missing_fields,
    concat_ws(';', CASE WHEN NOT target_time_match THEN 'forecast_target_time' END,
                   CASE WHEN NOT temperature_match THEN 'temperature' END,
                   CASE WHEN NOT dew_point_match THEN 'dew_point' END,
                   CASE WHEN NOT wind_speed_match THEN 'wind_speed' END) AS mismatch_fields,
    unsupported_terms,
    (NOT target_time_match OR NOT temperature_match OR NOT dew_point_match OR NOT wind_speed_match
       OR unsupported_terms <> '') AS hallucinated,
    response AS llm_response
  FROM v1b)"""

PERSIST = SERIES + """,
pers0 AS (
  SELECT idx - 95 AS sample_idx, date AS target_date,
         temperature AS y_t, dew_point AS y_d, wind_speed AS y_w,
         lag(temperature, 24) OVER (ORDER BY idx) AS p_t, lag(dew_point, 24) OVER (ORDER BY idx) AS p_d,
         lag(wind_speed, 24) OVER (ORDER BY idx) AS p_w
  FROM series),
pers1 AS (SELECT *, count(*) OVER () AS n_samples FROM pers0 WHERE sample_idx >= 0),
ptest AS (SELECT * FROM pers1 WHERE sample_idx >= floor(n_samples * 0.8)),
pm AS (
  SELECT avg(abs(y_t - p_t)) AS t_mae, avg(abs(y_d - p_d)) AS d_mae, avg(abs(y_w - p_w)) AS w_mae,
         sqrt(avg((y_t - p_t) * (y_t - p_t))) AS t_rmse, sqrt(avg((y_d - p_d) * (y_d - p_d))) AS d_rmse,
         sqrt(avg((y_w - p_w) * (y_w - p_w))) AS w_rmse, count(*) AS test_examples
  FROM ptest)"""

ARRAY_WINDOW = """
  count(*) OVER w AS x_size,
  round(sum(temperature + dew_point + wind_speed) OVER w, 4) AS x_sum,
  first_value(temperature) OVER w AS x_first_temperature,
  last_value(wind_speed) OVER w AS x_last_wind_speed"""

CASE_ACC = CASES + """,
acc AS (
  SELECT case_id, request_time, forecast_target_time,
    round(p_t, 4) AS predicted_temperature, round(a_t, 4) AS actual_temperature, round(abs(p_t - a_t), 4) AS temperature_abs_error,
    round(p_d, 4) AS predicted_dew_point, round(a_d, 4) AS actual_dew_point, round(abs(p_d - a_d), 4) AS dew_point_abs_error,
    round(p_w, 4) AS predicted_wind_speed, round(a_w, 4) AS actual_wind_speed, round(abs(p_w - a_w), 4) AS wind_speed_abs_error,
    round((abs(p_t - a_t) + abs(p_d - a_d) + abs(p_w - a_w)) / 3.0, 4) AS average_abs_error
  FROM cases)"""

EVEN = SERIES + """,
bounds AS (SELECT greatest(CAST(floor(max(n) * 0.8) AS BIGINT), 72) AS s, max(n) - 25 AS e FROM series),
picks AS (
  SELECT DISTINCT CASE WHEN k = 999 THEN e ELSE s + CAST(floor((k * (e - s)) / 999) AS BIGINT) END AS idx
  FROM bounds, (SELECT range AS k FROM range(1000)) ks),
sample AS (
  SELECT CAST(row_number() OVER (ORDER BY idx) AS BIGINT) AS case_id, idx FROM picks)"""

REQS = """
reqs AS (SELECT date AS request_time FROM series UNION ALL SELECT max(date) + INTERVAL 24 HOUR FROM series)"""


def _fmt(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


SQL = {
    "clean_hourly": "WITH " + SERIES + " SELECT date, temperature, dew_point, wind_speed FROM series",

    "null_counts": "WITH " + RAW + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count_if(date IS NULL) AS BIGINT) AS date_nulls,
       CAST(count_if(temperature IS NULL) AS BIGINT) AS temperature_nulls,
       CAST(count_if(dew_point IS NULL) AS BIGINT) AS dew_point_nulls,
       CAST(count_if(wind_speed IS NULL) AS BIGINT) AS wind_speed_nulls
FROM coerced""",

    "series_range": "WITH " + SERIES + """
SELECT CAST(count(*) AS BIGINT) AS rows, min(date) AS start_date, max(date) AS end_date FROM series""",

    "step_frequency": "WITH " + SERIES + """,
steps AS (SELECT CAST(epoch(date) - epoch(lag(date) OVER (ORDER BY idx)) AS BIGINT) AS step_seconds FROM series)
SELECT step_seconds, CAST(count(*) AS BIGINT) AS count FROM steps WHERE step_seconds IS NOT NULL
GROUP BY 1 ORDER BY count DESC, step_seconds LIMIT 5""",

    "panel_daily": "WITH " + PANEL + " SELECT l_suppkey, date, l_quantity, l_extendedprice, l_discount FROM panel",

    "row_position": "WITH " + SERIES + " SELECT date, idx, n FROM series",

    "window_train": "WITH " + SERIES + """
SELECT idx - 95 AS sample_idx, date AS target_date, """ + ARRAY_WINDOW + """,
  temperature AS y_temperature, dew_point AS y_dew_point, wind_speed AS y_wind_speed
FROM series WINDOW w AS (ORDER BY idx ROWS BETWEEN 95 PRECEDING AND 24 PRECEDING)
QUALIFY idx >= 95""",

    "window_verify": "WITH " + SERIES + """
SELECT idx, date AS request_date, """ + ARRAY_WINDOW + """,
  lead(date, 24) OVER o AS target_date, lead(temperature, 24) OVER o AS y_temperature,
  lead(dew_point, 24) OVER o AS y_dew_point, lead(wind_speed, 24) OVER o AS y_wind_speed
FROM series WINDOW w AS (ORDER BY idx ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING), o AS (ORDER BY idx)
QUALIFY idx >= 72 AND lead(date, 24) OVER o IS NOT NULL""",

    "window_flat": "WITH " + SERIES + """
SELECT s.idx AS sample_idx, CAST(p.pos AS BIGINT) AS pos,
       CASE p.pos % 3 WHEN 0 THEN r.temperature WHEN 1 THEN r.dew_point ELSE r.wind_speed END AS value
FROM series s, (SELECT range AS pos FROM range(216)) p, series r
WHERE s.idx <= s.n - 96 AND r.idx = s.idx + p.pos // 3""",

    "time_split": "WITH " + SERIES + """,
samp AS (SELECT idx - 95 AS sample_idx, date AS target_date, count(*) OVER () AS n_samples FROM series WHERE idx >= 95)
SELECT CASE WHEN sample_idx < floor(n_samples * 0.8) THEN 'train' ELSE 'test' END AS split,
       CAST(count(*) AS BIGINT) AS n_samples, min(sample_idx) AS first_sample, max(sample_idx) AS last_sample,
       min(target_date) AS first_target_date, max(target_date) AS last_target_date
FROM samp GROUP BY 1""",

    "history_check": "WITH " + SERIES + """
SELECT date, CAST(count(*) OVER (ORDER BY date RANGE BETWEEN INTERVAL 72 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS BIGINT)
         AS history_rows,
       count(*) OVER (ORDER BY date RANGE BETWEEN INTERVAL 72 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) = 72
         AS history_complete
FROM series""",

    "panel_windows": "WITH " + PANEL + """
SELECT l_suppkey, idx - 71 AS sample_idx, lead(date, 24) OVER o AS target_date,
  count(*) OVER w AS x_size, round(sum(l_quantity) OVER w, 4) AS x_sum_quantity, l_extendedprice AS x_last_price,
  lead(l_quantity, 24) OVER o AS y_l_quantity, lead(l_extendedprice, 24) OVER o AS y_l_extendedprice,
  lead(l_discount, 24) OVER o AS y_l_discount
FROM panel
WINDOW w AS (PARTITION BY l_suppkey ORDER BY idx ROWS BETWEEN 71 PRECEDING AND CURRENT ROW),
       o AS (PARTITION BY l_suppkey ORDER BY idx)
QUALIFY count(*) OVER w = 72 AND lead(date, 24) OVER o IS NOT NULL""",

    "persistence_mae": "WITH " + PERSIST + """
SELECT round(t_mae, 6) AS temperature_mae, round(d_mae, 6) AS dew_point_mae, round(w_mae, 6) AS wind_speed_mae,
       round((t_mae + d_mae + w_mae) / 3.0, 6) AS average_mae, CAST(test_examples AS BIGINT) AS test_examples
FROM pm""",

    "persistence_rmse_long": "WITH " + PERSIST + """
SELECT 'temperature' AS target, round(t_mae, 6) AS mae, round(t_rmse, 6) AS rmse FROM pm
UNION ALL SELECT 'dew_point', round(d_mae, 6), round(d_rmse, 6) FROM pm
UNION ALL SELECT 'wind_speed', round(w_mae, 6), round(w_rmse, 6) FROM pm
UNION ALL SELECT 'average', round((t_mae + d_mae + w_mae) / 3.0, 6), round((t_rmse + d_rmse + w_rmse) / 3.0, 6) FROM pm""",

    "case_accuracy": "WITH " + CASE_ACC + " SELECT * FROM acc",

    "accuracy_summary": "WITH " + CASE_ACC + """
SELECT 'ml_baseline' AS system, CAST(count(*) AS BIGINT) AS total_cases,
  round(COALESCE(avg(temperature_abs_error), 0.0), 4) AS temperature_mae,
  round(COALESCE(avg(dew_point_abs_error), 0.0), 4) AS dew_point_mae,
  round(COALESCE(avg(wind_speed_abs_error), 0.0), 4) AS wind_speed_mae,
  round(COALESCE(avg(average_abs_error), 0.0), 4) AS average_mae,
  round(max(temperature_abs_error), 4) AS max_temperature_abs_error,
  round(max(dew_point_abs_error), 4) AS max_dew_point_abs_error,
  round(max(wind_speed_abs_error), 4) AS max_wind_speed_abs_error,
  round(max(average_abs_error), 4) AS max_average_abs_error
FROM acc""",

    "verification_report": "WITH " + SERIES + """,
ver0 AS (
  SELECT idx, idx - 72 AS sample_idx, count(*) OVER w AS x_size,
         lead(temperature, 24) OVER o AS y_t, lead(dew_point, 24) OVER o AS y_d, lead(wind_speed, 24) OVER o AS y_w,
         lag(temperature, 1) OVER o AS p_t, lag(dew_point, 1) OVER o AS p_d, lag(wind_speed, 1) OVER o AS p_w,
         lead(date, 24) OVER o AS target_date
  FROM series WINDOW w AS (ORDER BY idx ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING), o AS (ORDER BY idx)),
ver AS (SELECT *, count(*) OVER () AS n_samples FROM ver0 WHERE x_size = 72 AND target_date IS NOT NULL),
vm AS (
  SELECT avg(abs(y_t - p_t)) AS t, avg(abs(y_d - p_d)) AS d, avg(abs(y_w - p_w)) AS w, count(*) AS test_examples
  FROM ver WHERE sample_idx >= floor(n_samples * 0.8))
SELECT (SELECT CAST(count(*) AS BIGINT) FROM series) AS dataset_rows,
       (SELECT min(date) FROM series) AS start_date, (SELECT max(date) FROM series) AS end_date,
       (SELECT CAST(count(*) AS BIGINT) FROM ver) AS x_rows, CAST(216 AS BIGINT) AS x_cols, CAST(3 AS BIGINT) AS y_cols,
       CAST(test_examples AS BIGINT) AS test_examples,
       round(t, 6) AS temperature_mae, round(d, 6) AS dew_point_mae, round(w, 6) AS wind_speed_mae,
       round((t + d + w) / 3.0, 6) AS average_mae
FROM vm""",

    "even_sample": "WITH " + EVEN + """
SELECT sample.case_id, sample.idx, series.date AS request_time FROM sample JOIN series USING (idx)""",

    "request_lookup": "WITH " + SERIES + "," + REQS + """,
f AS (
  SELECT date, idx, n, lag(date, 71) OVER o AS ws, date AS we, lead(date, 24) OVER o AS td,
         temperature AS p_t, dew_point AS p_d, wind_speed AS p_w,
         lead(temperature, 24) OVER o AS a_t, lead(dew_point, 24) OVER o AS a_d, lead(wind_speed, 24) OVER o AS a_w
  FROM series WINDOW o AS (ORDER BY idx)),
j AS (
  SELECT r.request_time, f.*,
    CASE WHEN f.idx IS NULL THEN 'not_found' WHEN f.idx < 71 THEN 'no_history'
         WHEN f.idx + 24 >= f.n THEN 'no_future' ELSE 'ok' END AS status
  FROM reqs r LEFT JOIN f ON f.date = r.request_time)
SELECT """ + _fmt("request_time") + """ AS request_time, status,
  CASE WHEN status = 'ok' THEN """ + _fmt("ws") + """ END AS input_window_start,
  CASE WHEN status = 'ok' THEN """ + _fmt("we") + """ END AS input_window_end,
  24 AS forecast_horizon_hours,
  CASE WHEN status = 'ok' THEN """ + _fmt("td") + """ END AS forecast_target_time,
  CASE WHEN status = 'ok' THEN round(p_t, 2) END AS predicted_temperature,
  CASE WHEN status = 'ok' THEN round(p_d, 2) END AS predicted_dew_point,
  CASE WHEN status = 'ok' THEN round(p_w, 2) END AS predicted_wind_speed,
  CASE WHEN status = 'ok' THEN round(a_t, 2) END AS actual_temperature,
  CASE WHEN status = 'ok' THEN round(a_d, 2) END AS actual_dew_point,
  CASE WHEN status = 'ok' THEN round(a_w, 2) END AS actual_wind_speed,
  CASE WHEN status = 'ok' THEN round(abs(p_t - a_t), 2) END AS temperature_abs_error,
  CASE WHEN status = 'ok' THEN round(abs(p_d - a_d), 2) END AS dew_point_abs_error,
  CASE WHEN status = 'ok' THEN round(abs(p_w - a_w), 2) END AS wind_speed_abs_error,
  CASE WHEN status = 'ok' THEN round((abs(p_t - a_t) + abs(p_d - a_d) + abs(p_w - a_w)) / 3.0, 2) END AS average_abs_error
FROM j""",

    "history_records": "WITH " + SERIES + "," + REQS + """,
h AS (
  SELECT r.request_time AS t, r.request_time - INTERVAL 72 HOUR AS hs, r.request_time - INTERVAL 1 HOUR AS he,
         count(s.date) AS returned, min(s.date) AS first_d, max(s.date) AS last_d, sum(s.temperature) AS tsum
  FROM (SELECT DISTINCT request_time FROM reqs) r
  LEFT JOIN series s ON s.date BETWEEN r.request_time - INTERVAL 72 HOUR AND r.request_time - INTERVAL 1 HOUR
  GROUP BY 1, 2, 3)
SELECT """ + _fmt("t") + """ AS target_time,
  CASE WHEN returned = 72 THEN 'ok' ELSE 'insufficient_history' END AS status,
  CAST(72 AS BIGINT) AS expected_records, CAST(returned AS BIGINT) AS returned_records,
  """ + _fmt("hs") + """ AS history_start, """ + _fmt("he") + """ AS history_end,
  CASE WHEN returned = 72 THEN """ + _fmt("first_d") + """ END AS first_record,
  CASE WHEN returned = 72 THEN """ + _fmt("last_d") + """ END AS last_record,
  CASE WHEN returned = 72 THEN round(tsum, 4) END AS temperature_sum
FROM h""",

    "eval_cases": "WITH " + EVEN + """,
f AS (
  SELECT idx, date, lead(date, 24) OVER o AS td,
         lag(temperature, 1) OVER o AS p_t, lag(dew_point, 1) OVER o AS p_d, lag(wind_speed, 1) OVER o AS p_w,
         lead(temperature, 24) OVER o AS a_t, lead(dew_point, 24) OVER o AS a_d, lead(wind_speed, 24) OVER o AS a_w
  FROM series WINDOW o AS (ORDER BY idx))
SELECT sample.case_id, """ + _fmt("f.date") + """ AS request_time, """ + _fmt("td") + """ AS forecast_target_time,
  round(p_t, 2) AS predicted_temperature, round(p_d, 2) AS predicted_dew_point, round(p_w, 2) AS predicted_wind_speed,
  round(a_t, 2) AS actual_temperature, round(a_d, 2) AS actual_dew_point, round(a_w, 2) AS actual_wind_speed,
  round(abs(p_t - a_t), 2) AS temperature_abs_error, round(abs(p_d - a_d), 2) AS dew_point_abs_error,
  round(abs(p_w - a_w), 2) AS wind_speed_abs_error
FROM sample JOIN f USING (idx) WHERE f.idx >= 72 AND td IS NOT NULL""",

    "verified_answers": "WITH " + CASES + f"""
SELECT case_id, TRUE AS verified, '' AS missing_fields, {_v2(T, X, Y, Z)} AS final_response FROM cases""",

    "refusals": "WITH " + CASES + """,
g AS (
  SELECT case_id, request_time, forecast_target_time, p_t,
         CASE WHEN o_orderstatus <> 'P' THEN p_d END AS p_d,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN p_w END AS p_w
  FROM cases),
m AS (
  SELECT *, concat_ws(';', CASE WHEN p_d IS NULL THEN 'predicted_dew_point' END,
                           CASE WHEN p_w IS NULL THEN 'predicted_wind_speed' END) AS missing,
         list_filter([CASE WHEN p_d IS NULL THEN 'prediction.dew_point' END,
                      CASE WHEN p_w IS NULL THEN 'prediction.wind_speed' END], lambda x: x IS NOT NULL) AS missing_v1
  FROM g)
SELECT case_id, missing = '' AS verified, missing AS missing_fields,
  CASE WHEN missing = '' THEN """ + _v2(T, X, Y, Z) + """
       ELSE 'I cannot produce a forecast because the verified tool output is missing required fields: '
            || replace(missing, ';', ', ') || '.' END AS final_response,
  CASE WHEN missing = '' THEN 'For the 24-hour forecast target time ' || forecast_target_time || ', the predicted temperature is '
            || CAST(p_t AS VARCHAR) || ', the predicted dew point is ' || CAST(p_d AS VARCHAR)
            || ', and the predicted wind speed is ' || CAST(p_w AS VARCHAR) || '.'
       ELSE 'I cannot produce a forecast because the tool output is missing required fields: ['
            || array_to_string(list_transform(missing_v1, lambda x: '''' || x || ''''), ', ') || ']' END AS v1_response
FROM m""",

    "prompts": "WITH " + CASES + """,
tj AS (
  SELECT *, '{' || chr(10) || '  "request_time": "' || request_time || '",' || chr(10)
         || '  "forecast_target_time": "' || forecast_target_time || '",' || chr(10)
         || '  "predicted_temperature": ' || CAST(p_t AS VARCHAR) || ',' || chr(10)
         || '  "predicted_dew_point": ' || CAST(p_d AS VARCHAR) || ',' || chr(10)
         || '  "predicted_wind_speed": ' || CAST(p_w AS VARCHAR) || chr(10) || '}' AS tool_json
  FROM cases)
SELECT case_id, 'Give me the weather forecast for 24 hours after ' || request_time || '.' AS user_request,
  replace(replace($$ANSWER$$, '{tool_json}', tool_json), '{request_time}', request_time) AS prompt,
  replace(replace($$PLAN$$, '{tool_json}', tool_json), '{request_time}', request_time) AS plan_prompt
FROM tj""",

    "batch_generate": "WITH " + CASES + f" SELECT case_id, {SINGLE_TEXT} AS llm_response FROM cases",

    "extract_fields": "WITH " + EXTRACT + """
SELECT case_id, system, obs_time AS observed_time, obs_t AS observed_temperature, obs_d AS observed_dew_point,
       obs_w AS observed_wind_speed FROM extracted""",

    "score_v2": "WITH " + SCORE_V2 + """
SELECT * EXCLUDE (llm_response), (value_hallucinated OR policy_violation) AS response_issue, llm_response FROM v2""",

    "score_single": "WITH " + SCORE_SINGLE + """
SELECT * EXCLUDE (llm_response), (value_hallucinated OR policy_violation) AS response_issue, llm_response FROM single""",

    "score_v1": "WITH " + SCORE_V1 + " SELECT * FROM v1",

    "terms_found": f"""
SELECT doc_id, {_terms('lower(text)', vocab.TERMS_V2)} AS terms_v2, {_terms('lower(text)', vocab.TERMS_V1)} AS terms_v1,
       {_terms("replace(lower(text), '_', ' ')", vocab.TERMS_SINGLE)} AS terms_single
FROM documents""",

    "summary_v2": "WITH " + SCORE_V2 + """
SELECT system, CAST(count(*) AS BIGINT) AS total_cases,
  CAST(count_if(value_hallucinated) AS BIGINT) AS value_hallucinated_cases,
  count_if(value_hallucinated) / count(*) AS value_hallucination_rate,
  CAST(count_if(policy_violation) AS BIGINT) AS policy_violation_cases,
  count_if(policy_violation) / count(*) AS policy_violation_rate,
  CAST(count_if(value_hallucinated OR policy_violation) AS BIGINT) AS response_issue_cases,
  count_if(value_hallucinated OR policy_violation) / count(*) AS response_issue_rate,
  count_if(target_time_match) / count(*) AS target_time_match_rate,
  count_if(temperature_match) / count(*) AS temperature_match_rate,
  count_if(dew_point_match) / count(*) AS dew_point_match_rate,
  count_if(wind_speed_match) / count(*) AS wind_speed_match_rate
FROM v2 GROUP BY system ORDER BY system""",

    "summary_v1": "WITH " + SCORE_V1 + """
SELECT system, CAST(count(*) AS BIGINT) AS total_cases, CAST(count_if(hallucinated) AS BIGINT) AS hallucinated_cases,
  count_if(hallucinated) / count(*) AS hallucination_rate,
  count_if(target_time_match) / count(*) AS target_time_match_rate,
  count_if(temperature_match) / count(*) AS temperature_match_rate,
  count_if(dew_point_match) / count(*) AS dew_point_match_rate,
  count_if(wind_speed_match) / count(*) AS wind_speed_match_rate,
  CAST(count_if(unsupported_terms <> '') AS BIGINT) AS unsupported_claim_cases
FROM v1 GROUP BY system ORDER BY system""",

    "summary_single": "WITH " + SCORE_SINGLE + """
SELECT CAST(count(*) AS BIGINT) AS records_scored,
  CAST(count_if(value_hallucinated) AS BIGINT) AS value_hallucinated_cases,
  count_if(value_hallucinated) / count(*) AS value_hallucination_rate,
  CAST(count_if(policy_violation) AS BIGINT) AS policy_violation_cases,
  count_if(policy_violation) / count(*) AS policy_violation_rate,
  CAST(count_if(value_hallucinated OR policy_violation) AS BIGINT) AS response_issue_cases,
  count_if(value_hallucinated OR policy_violation) / count(*) AS response_issue_rate,
  count_if(target_time_match) / count(*) AS target_time_match_rate,
  count_if(temperature_match) / count(*) AS temperature_match_rate,
  count_if(dew_point_match) / count(*) AS dew_point_match_rate,
  count_if(wind_speed_match) / count(*) AS wind_speed_match_rate
FROM single WHERE system = 'single_tool'""",

    "flag_counts": "WITH " + SCORE_V1 + """
SELECT system, hallucinated, CAST(count(*) AS BIGINT) AS count FROM v1 GROUP BY 1, 2""",

    "named_agg": "WITH " + SCORE_V1 + """
SELECT system, CAST(count(case_id) AS BIGINT) AS total_cases, CAST(sum(CAST(hallucinated AS INT)) AS BIGINT) AS hallucinated_cases,
  avg(CAST(target_time_match AS DOUBLE)) AS target_time_match_rate,
  avg(CAST(temperature_match AS DOUBLE)) AS temperature_match_rate,
  avg(CAST(dew_point_match AS DOUBLE)) AS dew_point_match_rate,
  avg(CAST(wind_speed_match AS DOUBLE)) AS wind_speed_match_rate,
  CAST(sum(CAST(hallucinated AS INT)) AS DOUBLE) / count(case_id) AS hallucination_rate
FROM v1 GROUP BY system""",
}


SQL["hallucinated_preview"] = "WITH " + SCORE_V1 + """
SELECT case_id, forecast_target_time_expected, expected_temperature, expected_dew_point, expected_wind_speed,
       missing_fields, mismatch_fields, unsupported_terms, llm_response
FROM v1 WHERE system = 'single_tool' AND hallucinated ORDER BY case_id LIMIT 5"""


SQL["csv_clean_hourly"] = SQL["clean_hourly"]
SQL["stream_score_v2"] = SQL["score_v2"]


def _fill_prompts():
    from ..operators.answers import ANSWER_PROMPT, PLANNING_PROMPT_V2
    q = SQL["prompts"]
    esc = lambda s: "'" + s.replace("'", "''") + "'"
    SQL["prompts"] = q.replace("$$ANSWER$$", esc(ANSWER_PROMPT)).replace("$$PLAN$$", esc(PLANNING_PROMPT_V2))


_fill_prompts()
