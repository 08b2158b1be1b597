"""Registered end-to-end queries over the driver tables (one per SURVEY §2 group).

Each function takes (spark, sf_dir) and returns a lazy DataFrame whose
columns are named exactly as in the matching SQL of :mod:`oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as T
from ..functions import vocab
from ..operators import accuracy, answers, clean, quality, records, requests, sampling, summary
from ..operators import windows as W
from ..sources import fixtures as fx
from ..sources.tables import read_table

MEASURES = vocab.MEASURES
NUM_CASES = 1000


# -- stage 1: clean + quality -------------------------------------------------

def q_clean_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """RAW -> clean hourly series (SRC-1 mapping, PRJ-2/4/5, FLT-1/2, AGG-1)."""
    return fx.series(spark, sf, with_idx=False)


def q_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Null count per coerced report column plus rows (AGG-12, PRJ-4)."""
    r = fx.raw_reports(spark, sf)
    coerced = r.select(
        F.col("date"),
        *[clean.lenient_number(F.col(c)).alias(c) for c in MEASURES],
    )
    return quality.null_counts(coerced, ["date"] + MEASURES)


def q_series_range(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, first and last hour of the series (AGG-13)."""
    return quality.series_range(fx.series(spark, sf, with_idx=False))


def q_step_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Five most common steps between consecutive hours (AGG-14, WIN-2, ORD-5)."""
    return quality.step_frequency(fx.series(spark, sf), top=5)


def q_panel_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Last value per (supplier, day) from lineitem (AGG-1 keyed, daily period)."""
    return fx.panel(spark, sf, with_idx=False)


# -- stage 2: positions + windows ------------------------------------------------

def q_row_position(spark: SparkSession, sf: str) -> DataFrame:
    """Dense position and series length per row (WIN-1)."""
    return fx.series(spark, sf).select("date", "idx", "n")


def _array_stats(df: DataFrame) -> list:
    x = F.col("x")
    total = F.aggregate(x, F.lit(0.0), lambda acc, s: acc + (s["temperature"] + s["dew_point"] + s["wind_speed"]))
    return [
        F.size(x).cast("bigint").alias("x_size"),
        F.round(total, 4).alias("x_sum"),
        F.get(x, 0)["temperature"].alias("x_first_temperature"),
        F.get(x, F.size(x) - 1)["wind_speed"].alias("x_last_wind_speed"),
    ]


def q_window_train(spark: SparkSession, sf: str) -> DataFrame:
    """Training windows: size, sum, first, last of the 72-row array and the target (WIN-3, WIN-7)."""
    w = W.train_windows(fx.series(spark, sf))
    return w.select("sample_idx", "target_date", *_array_stats(w), *[f"y_{m}" for m in MEASURES])


def q_window_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Verification windows r-72 .. r-1 with target r+24 (WIN-4, WIN-6)."""
    w = W.verify_windows(fx.series(spark, sf))
    return w.select("idx", F.col("date").alias("request_date"), *_array_stats(w), "target_date",
                    *[f"y_{m}" for m in MEASURES])


def q_window_flat(spark: SparkSession, sf: str) -> DataFrame:
    """Training windows flattened time-major to 216 values each (WIN-8)."""
    w = W.train_windows(fx.series(spark, sf))
    flat = w.select("sample_idx", F.posexplode(W.flatten_window(F.col("x"), MEASURES)).alias("pos", "value"))
    return flat.select("sample_idx", F.col("pos").cast("bigint").alias("pos"), "value")


def q_time_split(spark: SparkSession, sf: str) -> DataFrame:
    """Chronological 80/20 split of the training windows (WIN-9)."""
    w = W.train_windows(fx.series(spark, sf), arrays=False)
    sp = W.time_split(w)
    return sp.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_samples"),
        F.min("sample_idx").alias("first_sample"), F.max("sample_idx").alias("last_sample"),
        F.min("target_date").alias("first_target_date"), F.max("target_date").alias("last_target_date"),
    )


def q_history_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in [t-72h, t-1h] before each hour and the exact-count flag (WIN-11)."""
    h = W.history_counts(fx.series(spark, sf), hours=72)
    return h.select("date", "history_rows", "history_complete")


def q_panel_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Per-supplier training windows as frame aggregates, no arrays (WIN-3 keyed)."""
    p = fx.panel(spark, sf)
    fr = W.framed(p, "idx", ["l_suppkey"], back=71, forward=24)
    frame = fr.spec.rowsBetween(-71, 0)
    out = fr.df.select(
        "l_suppkey", "idx", "_chunk",
        F.count(F.lit(1)).over(frame).alias("x_size"),
        F.sum("l_quantity").over(frame).alias("x_sum_quantity"),
        F.col("l_extendedprice").alias("x_last_price"),
        F.lead("date", 24).over(fr.spec).alias("target_date"),
        *[F.lead(c, 24).over(fr.spec).alias(f"y_{c}") for c in fx.PANEL_MEASURES],
    )
    out = fr.home(out).where((F.col("x_size") == 72) & F.col("target_date").isNotNull())
    return out.select("l_suppkey", (F.col("idx") - 71).alias("sample_idx"), "target_date",
                      F.col("x_size").cast("bigint").alias("x_size"), F.round("x_sum_quantity", 4).alias("x_sum_quantity"),
                      "x_last_price", *[f"y_{c}" for c in fx.PANEL_MEASURES])


# -- stage 3: forecast accuracy -------------------------------------------------

def _persistence_test(spark: SparkSession, sf: str) -> DataFrame:
    p = W.persistence(fx.series(spark, sf))
    return W.time_split(p).where(F.col("split") == "test")


def q_persistence_mae(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence forecast MAE on the test split (WIN-10, WIN-9, AGG-9)."""
    m = accuracy.error_metrics(_persistence_test(spark, sf))
    return m.select(*[F.round(f"{c}_mae", 6).alias(f"{c}_mae") for c in MEASURES],
                    F.round("average_mae", 6).alias("average_mae"), F.col("test_examples").cast("bigint"))


def q_persistence_rmse_long(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence MAE / RMSE in long form, 4 rows (AGG-10, AGG-11)."""
    long = accuracy.metrics_long(accuracy.error_metrics(_persistence_test(spark, sf)))
    return long.select("target", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def q_case_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Per-case accuracy rows from CASES (FN-1..5, PRJ-10)."""
    return accuracy.case_scores(fx.cases(spark, sf))


def q_accuracy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy summary of the rounded case errors (AGG-2, AGG-3)."""
    return accuracy.summarize_cases(accuracy.case_scores(fx.cases(spark, sf)), system="ml_baseline")


def q_verification_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, range, window shapes and persistence MAE in the verification alignment (AGG-15, WIN-4).

    One halo-window pass gives, per series row r, inputs r-72 .. r-1
    (persistence = row r-1) and the target r+24; one global aggregate then
    takes the row count and range over all rows and the MAE over the test
    windows (conditional aggregates), so nothing is joined.
    """
    window, horizon = 72, 24
    f = requests.forecast_frame(fx.series(spark, sf), window=window, horizon=horizon, include_request_row=False)
    ok = F.col("status") == "ok"
    n_windows = F.col("n") - (window + horizon)
    test = ok & ((F.col("idx") - window) >= F.floor(n_windows.cast("double") * F.lit(0.8)))
    err = {m: F.when(test, F.abs(F.col(f"a_{m}") - F.col(f"p_{m}"))) for m in MEASURES}
    g = f.agg(
        F.count(F.lit(1)).cast("bigint").alias("dataset_rows"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count_if(ok).cast("bigint").alias("x_rows"),
        F.count_if(test).cast("bigint").alias("test_examples"),
        *[F.avg(err[m]).alias(f"_{m}") for m in MEASURES],
    )
    return g.select(
        "dataset_rows", "start_date", "end_date", "x_rows",
        F.lit(window * len(MEASURES)).cast("bigint").alias("x_cols"), F.lit(len(MEASURES)).cast("bigint").alias("y_cols"),
        "test_examples",
        *[F.round(f"_{m}", 6).alias(f"{m}_mae") for m in MEASURES],
        F.round((F.col("_temperature") + F.col("_dew_point") + F.col("_wind_speed")) / F.lit(3.0), 6).alias("average_mae"),
    )


# -- stage 4: requests + cases -------------------------------------------------

def q_even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Evenly spread request rows over the test region, numbered from 1 (ORD-4)."""
    e = sampling.even_sample(spark, fx.series(spark, sf), NUM_CASES)
    return e.select("case_id", "idx", F.col("date").alias("request_time"))


def q_request_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Batch of forecast requests with statuses and persistence predictions (ML-4, JN-2, FLT-4/6, UDF-4)."""
    s = fx.series(spark, sf)
    return requests.request_lookup(fx.requests(spark, sf, s), s)


def q_history_records(spark: SparkSession, sf: str) -> DataFrame:
    """History answer per request via the (day)-bucketed range join (JN-3, FLT-3, FN-29)."""
    s = fx.series(spark, sf)
    req = fx.requests(spark, sf, s).withColumnRenamed("request_time", "target_time")
    h = requests.history_records(req, s, window_size=72)
    rec = F.coalesce(F.col("records"), F.array())
    return h.select(
        "target_time", "status", "expected_records", "returned_records", "history_start", "history_end",
        T.fmt_ts(F.get(rec, 0)["date"]).alias("first_record"),
        T.fmt_ts(F.get(rec, F.size(rec) - 1)["date"]).alias("last_record"),
        F.round(F.aggregate(rec, F.lit(0.0), lambda a, r: a + r["temperature"]), 4).alias("temperature_sum"),
    ).withColumn("temperature_sum", F.when(F.col("status") == "ok", F.col("temperature_sum")))


def q_eval_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation cases at the sampled rows, flat form (ML-5, PRJ-7, JN-1)."""
    s = fx.series(spark, sf)
    samples = sampling.even_positions(sampling.series_lengths(s), NUM_CASES)
    return requests.eval_cases(samples, s)


# -- stage 5: answers ------------------------------------------------------------

def q_verified_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Verified-template answers for every case (UDF-3, FN-22, FN-24, PRJ-8/9)."""
    v = answers.verified_run(fx.cases(spark, sf))
    return v.select("case_id", F.col("verification.verified").alias("verified"),
                    F.array_join("verification.missing_fields", ";").alias("missing_fields"), "final_response")


def _cases_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """CASES with fields nulled by rule: dew point when status is P, wind when priority is 1-URGENT."""
    c = fx.cases(spark, sf, extra=("o_orderstatus", "o_orderpriority"))
    return c.withColumn("prediction", F.struct(
        F.col("prediction.temperature").alias("temperature"),
        F.when(F.col("o_orderstatus") != "P", F.col("prediction.dew_point")).alias("dew_point"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("prediction.wind_speed")).alias("wind_speed"),
    ))


def q_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals for cases with missing fields, v2 and v1 texts (FN-22..25)."""
    c = _cases_with_gaps(spark, sf).withColumn("tool_output", answers.tool_view())
    v2 = answers.verify_v2(F.col("tool_output"))
    v1 = answers.verify_v1(c)
    return c.select("case_id", v2.alias("v2"), v1.alias("v1")).select(
        "case_id", F.col("v2.verified").alias("verified"),
        F.array_join("v2.missing_fields", ";").alias("missing_fields"),
        answers.answer_v2(F.col("v2")).alias("final_response"),
        answers.answer_v1(F.col("v1")).alias("v1_response"),
    )


def q_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """User request, answer prompt and planning prompt per case (FN-26..28)."""
    c = fx.tool_output(fx.cases(spark, sf))
    return c.select("case_id", answers.user_request(F.col("request_time")).alias("user_request"),
                    answers.answer_prompt(c).alias("prompt"), answers.planning_prompt(c, "v2").alias("plan_prompt"))


def template_generator():
    """Deterministic stand-in for a text generator (test double for UDF-1).

    Reads the tool output out of each prompt, all it is given, and writes one of
    ten answer variants (chosen by the last digit of the wind speed, which in
    CASES is that of the case number).
    """
    def gen(prompts):
        fields = prompts.str.extract(r'"forecast_target_time": "([^"]*)",\s*"predicted_temperature": (\S+),\s*'
                                     r'"predicted_dew_point": (\S+),\s*"predicted_wind_speed": (\S+)')
        x, y, z = (fields[i].astype(float) for i in (1, 2, 3))
        return [_variant_text(round(w * 10) % 10, t, u, v, w) for t, u, v, w in zip(fields[0], x, y, z)]
    return gen


def _variant_text(v: int, t: str, x: float, y: float, z: float) -> str:
    v2 = lambda tt, xx, yy, zz: vocab.VERIFIED_V2.format(t=tt, x=xx, y=yy, z=zz)
    if v == 0:
        return v2(t, x, y, z)
    if v == 1:
        return vocab.VERIFIED_V1.format(t=t, x=x, y=y, z=z)
    if v == 2:
        return v2(t, round(x + 1.0, 2), y, z)
    if v == 3:
        return f"The forecast target time is {t}. The predicted temperature is {x}°F. The predicted dew point is {y}°F."
    if v == 4:
        return v2(t.replace(" ", "T"), x, y, z)
    if v == 5:
        return v2(t.replace(" ", "  "), x, y, z)
    if v == 6:
        return v2(t, x, y, z) + " Expect rain and humidity."
    if v == 7:
        return f"At {t}: {x}, {y}, {z}"
    if v == 8:
        return (f"forecast_target_time: {t}\npredicted_temperature: {x}\npredicted_dew_point: {y}\n"
                f"predicted_wind_speed: {z}\nabsolute_error: not reported")
    return (f"The forecast target time is {t}. The predicted temperature is\n{x}°F. The predicted dew point is\n"
            f"{round(y + 0.05, 2)}°F. The predicted wind speed is\n{z} mph.")


def q_batch_generate(spark: SparkSession, sf: str) -> DataFrame:
    """Generated answers through the pluggable generator over prompts (UDF-1, UDF-2)."""
    run = answers.single_tool_run(fx.tool_output(fx.cases(spark, sf)), template_generator)
    return run.select("case_id", "llm_response")


# -- stage 6: extraction + scoring -------------------------------------------------

def _responses_norm(spark: SparkSession, sf: str, profile: str = "v2") -> DataFrame:
    return records.normalise(fx.responses(spark, sf), profile=profile)


def q_extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Time and three values extracted from every response (FN-6..11)."""
    r = fx.responses(spark, sf)
    x = T.with_extracted(r.select("case_id", "system", records.response_text(r).alias("response")), "response", "x")
    return x.select("case_id", "system", F.col("x.forecast_target_time").alias("observed_time"),
                    *[F.col(f"x.predicted_{m}").alias(f"observed_{m}") for m in MEASURES])


def q_score_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows, profile v2 (FN-12, FN-17..21, PRJ-11, PRJ-13/14)."""
    return S.score_v2(_responses_norm(spark, sf))


def q_score_v1(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows, profile v1 (FN-13, FN-14, FN-16)."""
    return S.score_v1(_responses_norm(spark, sf, "v1"))


def q_score_single(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows, profile single (FN-15, PRJ-12)."""
    return S.score_single(_responses_norm(spark, sf), lists_as_text=True)


def q_terms_found(spark: SparkSession, sf: str) -> DataFrame:
    """Unsupported terms of all three vocabularies over whole documents (FN-15..17)."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select(
        "doc_id",
        T.found_terms_text(F.col("text"), vocab.TERMS_V2, False).alias("terms_v2"),
        T.found_terms_text(F.col("text"), vocab.TERMS_V1, False).alias("terms_v1"),
        T.found_terms_text(F.col("text"), vocab.TERMS_SINGLE, True).alias("terms_single"),
    )


# -- stage 7: summaries --------------------------------------------------------------

def q_summary_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Per-system summary of v2 scores (AGG-4, SET-2)."""
    return summary.summarize_v2(S.score_v2(_responses_norm(spark, sf), lists_as_text=False))


def q_summary_v1(spark: SparkSession, sf: str) -> DataFrame:
    """Per-system summary of v1 scores (AGG-5)."""
    return summary.summarize_v1(S.score_v1(_responses_norm(spark, sf, "v1"), lists_as_text=False))


def q_summary_single(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-table report of the single-tool profile (AGG-6, FLT-5)."""
    single = _responses_norm(spark, sf).where(F.col("system") == "single_tool")
    return summary.summarize_table(S.score_single(single))


def q_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Group sizes by system and flag (AGG-7)."""
    return summary.flag_counts(S.score_v1(_responses_norm(spark, sf, "v1")))


def q_named_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Named multi-aggregate per system (AGG-8)."""
    return summary.named_summary(S.score_v1(_responses_norm(spark, sf, "v1")))


def q_hallucinated_preview(spark: SparkSession, sf: str) -> DataFrame:
    """First 5 hallucinated single-tool cases by id (FLT-5, ORD-2): a preview report."""
    sc = S.score_v1(_responses_norm(spark, sf, "v1"))
    flagged = sc.where((F.col("system") == "single_tool") & F.col("hallucinated"))
    return quality.preview(flagged, 5).select(
        "case_id", "forecast_target_time_expected", *[f"expected_{m}" for m in MEASURES],
        "missing_fields", "mismatch_fields", "unsupported_terms", "llm_response")


def q_csv_clean_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Raw reports written as a report CSV (SNK-1) and scanned back (SRC-1), then cleaned."""
    from ..operators.clean import RAW_RENAMES
    from ..session import scratch_path
    from ..sources import files

    names = {v: k for k, v in RAW_RENAMES.items()}
    raw = fx.raw_reports(spark, sf).select(
        F.lit("STATION-1").alias("STATION"), F.col("event_id").alias("REPORT_ID"),
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(names["date"]),
        *[F.col(m).alias(names[m]) for m in MEASURES],
    )
    path = scratch_path(spark, "raw-csv")
    files.write_csv(raw, path)
    back = files.read_raw_reports(spark, path, keep=["REPORT_ID"])
    back = back.withColumn("REPORT_ID", F.col("REPORT_ID").cast("bigint"))
    return clean.clean_hourly(back, unique_tie="REPORT_ID")


def q_stream_score_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Response records written as JSONL (SNK-4), read as a file stream (SRC-6) and scored (v2)."""
    from ..session import scratch_path
    from ..sources import files
    from ..streaming import hourly

    path = scratch_path(spark, "responses-jsonl")
    files.write_jsonl(fx.responses(spark, sf), path, gzip=True)
    stream = spark.readStream.schema(files.RESPONSE_SCHEMA).option("maxFilesPerTrigger", 64).json(path)
    return hourly.run_available_now(hourly.score_stream(stream, "v2"), "stream-score")


QUERIES = {
    "clean_hourly": q_clean_hourly,
    "null_counts": q_null_counts,
    "series_range": q_series_range,
    "step_frequency": q_step_frequency,
    "panel_daily": q_panel_daily,
    "row_position": q_row_position,
    "window_train": q_window_train,
    "window_verify": q_window_verify,
    "window_flat": q_window_flat,
    "time_split": q_time_split,
    "history_check": q_history_check,
    "panel_windows": q_panel_windows,
    "persistence_mae": q_persistence_mae,
    "persistence_rmse_long": q_persistence_rmse_long,
    "case_accuracy": q_case_accuracy,
    "accuracy_summary": q_accuracy_summary,
    "verification_report": q_verification_report,
    "even_sample": q_even_sample,
    "request_lookup": q_request_lookup,
    "history_records": q_history_records,
    "eval_cases": q_eval_cases,
    "verified_answers": q_verified_answers,
    "refusals": q_refusals,
    "prompts": q_prompts,
    "batch_generate": q_batch_generate,
    "extract_fields": q_extract_fields,
    "score_v2": q_score_v2,
    "score_v1": q_score_v1,
    "score_single": q_score_single,
    "terms_found": q_terms_found,
    "summary_v2": q_summary_v2,
    "summary_v1": q_summary_v1,
    "summary_single": q_summary_single,
    "flag_counts": q_flag_counts,
    "named_agg": q_named_agg,
    "hallucinated_preview": q_hallucinated_preview,
    "csv_clean_hourly": q_csv_clean_hourly,
    "stream_score_v2": q_stream_score_v2,
}
