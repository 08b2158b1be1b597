"""Registered queries over files, keyed series, small chunks and foreign text, with their DuckDB SQL.

The chunk sizes here are small on purpose, so that windows cross chunk edges
on the test tables; a chunk never changes a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as T
from ..functions import vocab
from ..operators import answers, records, requests, sampling, summary
from ..operators import windows as W
from ..session import scratch_path
from ..sources import files
from ..sources import fixtures as fx
from . import oracle as O
from .queries import MEASURES, _array_stats, template_generator

KEY = ["l_suppkey"]
ARABIC_INDIC = "".join(chr(0x660 + i) for i in range(10))
RUN_TIME, MODEL = "2025-01-01T00:00:00", "models/forecast"


# -- small chunks and keyed series ---------------------------------------------------------

def q_window_train_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Training windows over chunks of 120 rows (WIN-3, WIN-7 across chunk edges)."""
    w = W.train_windows(fx.series(spark, sf), chunk=120)
    return w.select("sample_idx", "target_date", *_array_stats(w), *[f"y_{m}" for m in MEASURES])


def q_history_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """History counts over chunks of 80 hours (WIN-11 across chunk edges)."""
    return W.history_counts(fx.series(spark, sf), hours=72, chunk_hours=80).select("date", "history_rows", "history_complete")


def q_panel_persistence(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence errors per supplier on each supplier's test split (WIN-9, WIN-10 keyed)."""
    p = W.time_split(W.persistence(fx.panel(spark, sf), fx.PANEL_MEASURES, KEY, chunk=100), KEY)
    err = F.abs(F.col("y_l_quantity") - F.col("p_l_quantity"))
    return p.where("split = 'test'").groupBy(*KEY).agg(
        F.count(F.lit(1)).cast("bigint").alias("test_examples"), F.round(F.avg(err), 6).alias("quantity_mae"))


def q_panel_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty evenly spread request rows for each supplier (ORD-4 keyed)."""
    e = sampling.even_sample(spark, fx.panel(spark, sf), 20, keys=KEY)
    return e.select(*KEY, "case_id", "idx", F.col("date").alias("request_time"))


def q_panel_history(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the ten days before each day of a supplier (WIN-11 keyed)."""
    h = W.history_counts(fx.panel(spark, sf), KEY, hours=240, chunk_hours=24 * 30)
    return h.select(*KEY, "date", "history_rows", "history_complete")


def q_panel_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast frame of every supplier day: status, window start, prediction, target (JN-1, FLT-6 keyed)."""
    f = requests.forecast_frame(fx.panel(spark, sf), fx.PANEL_MEASURES, KEY, chunk=100)
    return f.select(*KEY, "date", "status", "input_window_start", "target_date", "p_l_quantity", "a_l_quantity")


# -- files ---------------------------------------------------------------------------------------

def q_file_series(spark: SparkSession, sf: str) -> DataFrame:
    """SERIES written as CSV with a ``DATE`` column, read strictly, then through Parquet (SRC-2..5, SNK-1/2, PRJ-3)."""
    as_csv, as_parquet = scratch_path(spark, "series-csv"), scratch_path(spark, "series-parquet")
    files.write_csv(fx.series(spark, sf, with_idx=False).withColumnRenamed("date", "DATE"), as_csv)
    files.write_parquet(files.read_series(spark, as_csv), as_parquet)
    return files.read_series(spark, as_parquet, "parquet")


def q_file_records(spark: SparkSession, sf: str) -> DataFrame:
    """Two systems' JSONL logs, one appended to, and one absent, read as tagged records (SNK-4/5, SRC-6/7, SET-1)."""
    r = fx.responses(spark, sf)
    paths = {name: scratch_path(spark, f"log-{name}") for name in ("agentic", "single_tool", "absent")}
    files.write_jsonl(r.where("system = 'agentic'"), paths["agentic"], gzip=True)
    single = r.where("system = 'single_tool'")
    files.write_jsonl(single.where("case_id % 2 = 0"), paths["single_tool"], mode="append", gzip=True)
    files.write_jsonl(single.where("case_id % 2 <> 0 OR case_id IS NULL"), paths["single_tool"], mode="append", gzip=True)
    back = files.read_records(spark, paths)
    return records.normalise(back.drop("system", "system_type")).drop("request_time")


def q_file_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Single-profile scores written as the score CSV and read back (SNK-3, SRC-8)."""
    path = scratch_path(spark, "score-csv")
    scored = S.score_single(records.normalise(fx.responses(spark, sf)))
    files.write_csv(scored, path, columns=files.SINGLE_SCORE_COLUMNS, python_bools=True)
    flags = [c for c in files.SINGLE_SCORE_COLUMNS if c.endswith("_match")] + ["value_hallucinated", "policy_violation", "response_issue"]
    numbers = [f"{kind}_{m}" for kind in ("expected", "observed") for m in MEASURES]
    types = {**dict.fromkeys(flags, "boolean"), **dict.fromkeys(numbers, "double")}
    return files.read_scores_csv(spark, path, ", ".join(f"{c} {types.get(c, 'string')}" for c in files.SINGLE_SCORE_COLUMNS))


def q_file_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The v2 summary written as one JSON document and read back as rows (SNK-6)."""
    path = scratch_path(spark, "summary-json")
    s = summary.summarize_v2(S.score_v2(records.normalise(fx.responses(spark, sf)), lists_as_text=False))
    files.write_summary_json(s, path, pretty=True)
    metrics = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in s.schema.fields if f.name != "system")
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", f"map<string, struct<{metrics}>>")).alias("system", "m")).select("system", "m.*")


# -- answers ---------------------------------------------------------------------------------------

def q_run_records(spark: SparkSession, sf: str) -> DataFrame:
    """Both systems' run records with run time and model path (PRJ-8/9, FN-31, UDF-2/3)."""
    c = fx.cases(spark, sf)
    runs = [answers.verified_run(c, RUN_TIME, model_path=MODEL),
            answers.single_tool_run(c, template_generator, RUN_TIME, model_path=MODEL)]
    cols = ["run_timestamp", "system", "system_type", "model_path", "case_id", "request_time", "forecast_target_time",
            *[F.col(f"tool_output.predicted_{m}").alias(f"tool_{m}") for m in MEASURES],
            *[F.col(f"{s}.{m}").alias(f"{s}_{m}") for s in ("actual", "absolute_error") for m in MEASURES],
            "user_request", "llm_response"]
    return runs[0].select(*cols).unionByName(runs[1].select(*cols))


def q_first_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 cases by number (ORD-3: a top-k report)."""
    return sampling.first_cases(fx.cases(spark, sf), 50).select("case_id", "request_time", "forecast_target_time")


def q_prompts_all(spark: SparkSession, sf: str) -> DataFrame:
    """Planning prompt v1 and the prototypes' prompts per case (FN-26)."""
    c = fx.tool_output(fx.cases(spark, sf))
    return c.select("case_id", answers.planning_prompt(c, "v1").alias("plan_prompt_v1"),
                    answers.prototype_prompt().alias("prototype_prompt"), answers.chat_prompts().alias("chat")).select(
        "case_id", "plan_prompt_v1", "prototype_prompt",
        F.col("chat.system").alias("chat_system_prompt"), F.col("chat.user").alias("chat_user_prompt"))


def q_extract_foreign(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction from answers with no-break blanks and, in odd cases, Arabic-Indic digits (FN-7..11)."""
    c = fx.tool_output(fx.cases(spark, sf))
    text = answers.answer_v2(answers.verify_v2(F.col("tool_output")))
    text = F.replace(text, F.lit(" is "), F.lit("\u202fis\u00a0"))
    text = F.regexp_replace(text, r"(\d) (\d)", "$1\u00a0$2")
    text = F.when(F.col("case_id") % 2 == 1, F.translate(text, "0123456789", ARABIC_INDIC)).otherwise(text)
    x = T.with_extracted(c.select("case_id", text.alias("response")), "response", "x")
    return x.select("case_id", F.col("x.forecast_target_time").alias("observed_time"),
                    *[F.col(f"x.predicted_{m}").alias(f"observed_{m}") for m in MEASURES])


QUERIES = {
    "window_train_chunks": q_window_train_chunks, "history_chunks": q_history_chunks,
    "panel_persistence": q_panel_persistence, "panel_cases": q_panel_cases, "panel_history": q_panel_history,
    "panel_lookup": q_panel_lookup, "file_series": q_file_series, "file_records": q_file_records,
    "file_scores": q_file_scores, "file_summary": q_file_summary, "run_records": q_run_records,
    "first_cases": q_first_cases, "prompts_all": q_prompts_all, "extract_foreign": q_extract_foreign,
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _filled(template: str) -> str:
    """SQL text of a prompt with its request and tool output filled in."""
    return (f"replace(replace(replace({_text(template)}, '{{user_request}}', 'Give me the weather forecast for 24 hours after ' "
            "|| request_time || '.'), '{tool_json}', tool_json), '{request_time}', request_time)")


_KEYED = "WITH " + O.PANEL + ", keyed AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n FROM panel)"
_CASE_ERRORS = """round(abs(p_t - a_t), 2) AS absolute_error_temperature, round(abs(p_d - a_d), 2) AS absolute_error_dew_point,
  round(abs(p_w - a_w), 2) AS absolute_error_wind_speed"""
_FLAGS = ("target_time_match, expected_temperature, observed_temperature, temperature_match, expected_dew_point, observed_dew_point, "
          "dew_point_match, expected_wind_speed, observed_wind_speed, wind_speed_match")


def _run_sql(system: str, kind: str, response: str) -> str:
    return f"""SELECT '{RUN_TIME}' AS run_timestamp, '{system}' AS system, '{kind}' AS system_type, '{MODEL}' AS model_path,
  case_id, request_time, forecast_target_time, p_t AS tool_temperature, p_d AS tool_dew_point, p_w AS tool_wind_speed,
  a_t AS actual_temperature, a_d AS actual_dew_point, a_w AS actual_wind_speed, {_CASE_ERRORS},
  'Give me the weather forecast for 24 hours after ' || request_time || '.' AS user_request, {response} AS llm_response FROM cases"""


SQL = {
    "window_train_chunks": O.SQL["window_train"],
    "history_chunks": O.SQL["history_check"],
    "panel_persistence": _KEYED + """,
p AS (SELECT *, idx - 95 AS s, n - 95 AS m, lag(l_quantity, 24) OVER (PARTITION BY l_suppkey ORDER BY idx) AS before FROM keyed)
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS test_examples, round(avg(abs(l_quantity - before)), 6) AS quantity_mae
FROM p WHERE s >= 0 AND s >= floor(m * 0.8) GROUP BY 1""",
    "panel_cases": _KEYED + """,
b AS (SELECT DISTINCT l_suppkey, greatest(CAST(floor(n * 0.8) AS BIGINT), 72) AS s, n - 25 AS e FROM keyed),
picks AS (
  SELECT DISTINCT l_suppkey, CASE WHEN k = 19 THEN e ELSE s + CAST(floor((k * (e - s)) / 19) AS BIGINT) END AS idx
  FROM b, (SELECT range AS k FROM range(20)) ks WHERE e >= s),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY idx) AS BIGINT) AS case_id FROM picks)
SELECT l_suppkey, case_id, idx, date AS request_time FROM numbered JOIN panel USING (l_suppkey, idx)""",
    "panel_history": "WITH " + O.PANEL + """
SELECT l_suppkey, date, CAST(count(*) OVER w AS BIGINT) AS history_rows, count(*) OVER w = 240 AS history_complete
FROM panel WINDOW w AS (PARTITION BY l_suppkey ORDER BY date RANGE BETWEEN INTERVAL 240 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)""",
    "panel_lookup": _KEYED + """
SELECT l_suppkey, date, CASE WHEN idx < 71 THEN 'no_history' WHEN idx + 24 >= n THEN 'no_future' ELSE 'ok' END AS status,
  lag(date, 71) OVER w AS input_window_start, lead(date, 24) OVER w AS target_date,
  l_quantity AS p_l_quantity, lead(l_quantity, 24) OVER w AS a_l_quantity
FROM keyed WINDOW w AS (PARTITION BY l_suppkey ORDER BY idx)""",
    "file_series": O.SQL["clean_hourly"],
    "file_records": "WITH " + O.RESPONSES + """
SELECT case_id, system, forecast_target_time AS expected_time, p_t AS expected_temperature, p_d AS expected_dew_point,
  p_w AS expected_wind_speed, response FROM responses""",
    "file_scores": "WITH " + O.SCORE_SINGLE + f"""
SELECT request_time, forecast_target_time_expected, forecast_target_time_observed, {_FLAGS},
  NULLIF(missing_fields, '') AS missing_fields, NULLIF(mismatch_fields, '') AS mismatch_fields, NULLIF(extra_terms, '') AS extra_terms,
  value_hallucinated, policy_violation, (value_hallucinated OR policy_violation) AS response_issue, llm_response FROM single""",
    "file_summary": O.SQL["summary_v2"],
    "run_records": "WITH " + O.CASES + " " + _run_sql("agentic", "agentic_verification_pipeline", O._v2(O.T, O.X, O.Y, O.Z))
    + " UNION ALL " + _run_sql("single_tool", "single_tool_local_model", O.SINGLE_TEXT),
    "first_cases": "WITH " + O.CASES + " SELECT case_id, request_time, forecast_target_time FROM cases ORDER BY case_id LIMIT 50",
    "prompts_all": "WITH " + O.CASES + """,
tj AS (
  SELECT *, '{' || chr(10) || '  "request_time": "' || request_time || '",' || chr(10)
         || '  "forecast_target_time": "' || forecast_target_time || '",' || chr(10)
         || '  "predicted_temperature": ' || CAST(p_t AS VARCHAR) || ',' || chr(10)
         || '  "predicted_dew_point": ' || CAST(p_d AS VARCHAR) || ',' || chr(10)
         || '  "predicted_wind_speed": ' || CAST(p_w AS VARCHAR) || chr(10) || '}' AS tool_json
  FROM cases)
SELECT case_id, """ + f"""{_filled(answers.PLANNING_PROMPT_V1)} AS plan_prompt_v1, {_filled(answers.PROTOTYPE_PROMPT)} AS prototype_prompt,
  {_text(answers.CHAT_SYSTEM_PROMPT)} AS chat_system_prompt, {_filled(answers.CHAT_USER_PROMPT)} AS chat_user_prompt FROM tj""",
    # what a reader finds: the time with its own blank and digits, the values as numbers
    "extract_foreign": "WITH " + O.CASES + """
SELECT case_id, CASE WHEN case_id % 2 = 1 THEN translate(replace(forecast_target_time, ' ', chr(160)), '0123456789', '""" + ARABIC_INDIC + """')
       ELSE replace(forecast_target_time, ' ', chr(160)) END AS observed_time,
  p_t AS observed_temperature, p_d AS observed_dew_point, p_w AS observed_wind_speed FROM cases""",
}
