"""Extraction and scoring: goldens, closure, quirks, and texts worked out by hand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import DATA, SF_SMALL
from hourglass.functions import score as S
from hourglass.functions import text as T
from hourglass.functions import vocab
from hourglass.operators import accuracy, answers, records
from hourglass.sources import files, fixtures as fx


# text -> (time, temperature, dew point, wind speed), worked out by hand
EXTRACTED = [
    ("", (None, None, None, None)),
    ("no figures here", (None, None, None, None)),
    ("At 2005-04-13 08:00:00 the temperature is 57.39, dew point: 54.07 and wind speed = 5.64 mph", ("2005-04-13 08:00:00", 57.39, 54.07, 5.64)),
    ("predicted_temperature: -4 predicted_dew_point: -12.5 predicted_wind_speed: 0", (None, -4.0, -12.5, 0.0)),
    ("Temp 5 dewpoint 6 wind 7", (None, 5.0, 6.0, 7.0)),
    ("2005-04-13T08:00:00 temperature 1", (None, 1.0, -4.0, -13.0)),
    ("2005-04-13 08:00:00 1.5 2.5 3.5", ("2005-04-13 08:00:00", 1.5, 2.5, 3.5)),
    ("2005-04-13 08:00:00 1.5 2.5", ("2005-04-13 08:00:00", None, None, None)),
    ("1 2 3 then temperature 9", (None, 9.0, 2.0, 3.0)),
    ("temperature about 71 degrees", (None, 71.0, None, None)),
    ("temperature\nabout 71", (None, None, None, None)),
    ("2005-04-13 08:00:00 and 2006-01-01 00:00:00", ("2005-04-13 08:00:00", 2006.0, -1.0, -1.0)),
    ("wind speed of 12.05 and wind 3", (None, None, None, 12.05)),
]


def test_extraction_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXTRACTED)], "i int, t string")
    got = T.with_extracted(df, "t").select("i", "_x.*").orderBy("i").collect()
    for r, (text, want) in zip(got, EXTRACTED):
        assert tuple(r)[1:] == want, text


def test_terms_are_substrings_in_order(spark):
    df = spark.createDataFrame([("Train caused Cloudy ERROR; absolute_error",)], "t string")
    r = df.select(T.found_terms("t", vocab.TERMS_V2, False).alias("v2"), T.found_terms("t", vocab.TERMS_SINGLE, True).alias("single")).first()
    assert r["v2"] == ["error", "rain", "cloudy", "cloud"]
    assert r["single"] == ["absolute error", "cloud", "rain", "cause", "caused"]


def test_accuracy_golden_50_cases(spark):
    cases = files.read_jsonl(spark, os.path.join(DATA, "eval_cases_50.jsonl"), files.CASE_SCHEMA)
    s = accuracy.summarize_cases(accuracy.case_scores(cases)).first()
    assert s["total_cases"] == 50
    assert (s["temperature_mae"], s["dew_point_mae"], s["wind_speed_mae"], s["average_mae"]) == (5.1076, 5.082, 3.7062, 4.6319)
    assert (s["max_temperature_abs_error"], s["max_dew_point_abs_error"], s["max_wind_speed_abs_error"],
            s["max_average_abs_error"]) == (18.28, 15.19, 16.81, 15.2167)


def test_single_profile_golden(spark):
    rec = files.read_jsonl(spark, os.path.join(DATA, "single_response.jsonl"), files.RESPONSE_SCHEMA)
    r = S.score_single(records.normalise(rec)).first()
    assert r["system"] == "single_tool"
    assert (r["target_time_match"], r["temperature_match"], r["dew_point_match"], r["wind_speed_match"]) == (True,) * 4
    assert r["observed_temperature"] == 57.39 and r["observed_dew_point"] == 54.07 and r["observed_wind_speed"] == 5.64
    assert r["extra_terms"] == ["actual", "absolute error"]
    assert (r["value_hallucinated"], r["policy_violation"], r["response_issue"]) == (False, True, True)
    assert r["missing_fields"] == [] and r["mismatch_fields"] == []


def test_verified_answers_have_no_issue(spark):
    """Closure: anything the verified template writes is scored clean by v2."""
    v = answers.verified_run(fx.cases(spark, SF_SMALL))
    s = S.score_v2(records.normalise(v), lists_as_text=False)
    assert s.where("response_issue").count() == 0
    assert s.count() == 1500


def test_v1_counts_any_number(spark):
    df = spark.createDataFrame([(1, "agentic", "r", "2005-04-13 08:00:00", 57.39, 54.07, 8.0,
                                 "At 2005-04-13 08:00:00 it is 57.39 and 54.07.")],
                               "case_id long, system string, request_time string, expected_time string, "
                               "expected_temperature double, expected_dew_point double, expected_wind_speed double, "
                               "response string")
    r = S.score_v1(df, lists_as_text=False).first()
    assert r["wind_speed_match"] is True     # the hour '08' counts as 8.0
    assert r["hallucinated"] is False


def test_expected_precedence(spark):
    df = spark.createDataFrame(
        [(1, {"forecast_target_time": "t1", "predicted_temperature": 1.0, "predicted_dew_point": 2.0,
              "predicted_wind_speed": 3.0}, {"temperature": 9.0, "dew_point": 9.0, "wind_speed": 9.0}, "t0"),
         (2, None, {"temperature": 4.0, "dew_point": 5.0, "wind_speed": 6.0}, "t2")],
        "case_id long, tool_output struct<forecast_target_time:string,predicted_temperature:double,"
        "predicted_dew_point:double,predicted_wind_speed:double>, prediction struct<temperature:double,"
        "dew_point:double,wind_speed:double>, forecast_target_time string")
    rows = records.normalise(df.withColumn("llm_response", F.lit("x"))).orderBy("case_id").collect()
    assert (rows[0]["expected_time"], rows[0]["expected_temperature"]) == ("t1", 1.0)
    assert (rows[1]["expected_time"], rows[1]["expected_wind_speed"]) == ("t2", 6.0)


def test_prompt_json_matches_python(spark):
    c = fx.tool_output(fx.cases(spark, SF_SMALL)).orderBy("case_id").limit(5)
    got = c.select(answers.answer_prompt(c).alias("p"), "tool_output").collect()
    for r in got:
        to = r["tool_output"].asDict()
        assert json.dumps(to, indent=2) in r["p"]


def test_refusal_texts(spark):
    df = spark.createDataFrame([(1, "a", "b", {"temperature": 1.5, "dew_point": None, "wind_speed": None})],
                               "case_id long, request_time string, forecast_target_time string, "
                               "prediction struct<temperature:double,dew_point:double,wind_speed:double>")
    v2 = answers.verified_run(df).first()
    assert v2["final_response"] == ("I cannot produce a forecast because the verified tool output is missing required "
                                    "fields: predicted_dew_point, predicted_wind_speed.")
    v1 = answers.verified_run_v1(df).first()
    assert v1["llm_response"] == ("I cannot produce a forecast because the tool output is missing required fields: "
                                  "['prediction.dew_point', 'prediction.wind_speed']")


def test_plan_is_stored_but_never_changes_the_answer(spark):
    def planner():
        return lambda pdf: ["1. Identify the request time. It will likely rain." for _ in range(len(pdf))]
    c = fx.cases(spark, SF_SMALL)
    with_plan = answers.verified_run(c, plan_generator_factory=planner, model_path="/models/m.gguf")
    plain = answers.verified_run(c)
    assert with_plan.where("agent_plan IS NULL").count() == 0
    a = with_plan.select("case_id", "final_response")
    b = plain.select("case_id", "final_response")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 1500
    assert with_plan.select("model_path").distinct().first()[0] == "/models/m.gguf"


def test_blanks_and_digits_of_other_scripts(spark):
    cases = [
        ("predicted temperature is ٥٤.5 at 2024-01-02 03:04:05, dew point: ١٢ wind 3.5",
         ("2024-01-02 03:04:05", 54.5, 12.0, 3.5)),
        ("at 2024-01-02 03:04:05: 1, ٢, 3.5", ("2024-01-02 03:04:05", 1.0, 2.0, 3.5)),
        ("at ٢٠٢٤-01-02 03:04:05 temperature 7", ("٢٠٢٤-01-02 03:04:05", 7.0, None, None)),
        ("temperature　= 7", (None, 7.0, None, None)),
        ("", (None, None, None, None)),
        (None, (None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = df.select("i", T.extract_forecast_fields("t").alias("x")).orderBy("i").collect()
    assert [tuple(r["x"]) for r in got] == [want for _, want in cases]


def test_number_text_as_python_writes_it(spark):
    xs = [1e7, 5e-4, 1e16, 1e-5, 0.0, 1.5e-5, 123456789.125, 9999999.999, 0.001, 1e22, -2.5e-4, 1e300, 54.0,
          float("inf"), float("-inf"), float("nan")]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", T.fmt_num("x").alias("t"))
    assert [r["t"] for r in got.orderBy("i").collect()] == [str(x) for x in xs]
    assert spark.createDataFrame([(None,)], "x double").select(T.fmt_num("x")).first()[0] is None


def test_verified_answers_of_large_and_small_values_score_clean(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00", (1e7, 5e-4, 12345678.5))],
                               "case_id long, request_time string, forecast_target_time string, "
                               "prediction struct<temperature:double,dew_point:double,wind_speed:double>")
    r = S.score_v2(records.normalise(answers.verified_run(df))).first()
    assert (r["missing_fields"], r["mismatch_fields"], r["observed_temperature"]) == ("", "", 1e7)


def test_generator_gets_prompts_and_nothing_else(spark):
    def factory():
        return lambda prompts: [f"{type(prompts).__name__} {prompts.name in (None, '_0', 'prompt')} {p[:9]}" for p in prompts]

    run = answers.single_tool_run(fx.cases(spark, SF_SMALL), factory)
    assert {r[0] for r in run.select("llm_response").distinct().collect()} == {"Series True You are a"}
