"""Sources, sinks, model save / load, streaming forms."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hourglass.functions import score as S
from hourglass.operators import forecast, records, summary
from hourglass.sources import files, fixtures as fx
from hourglass.streaming import hourly


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', "a\nb", None, ["x", "y"])],
                               "id int, a string, b string, c string, l array<string>")
    p = str(tmp_path / "csv")
    files.write_csv(df, p)
    back = files.read_scores_csv(spark, p, "id int, a string, b string, c string, l string").first()
    assert (back["a"], back["b"], back["c"], back["l"]) == ('say "hi", ok', "a\nb", None, "x;y")


def test_jsonl_strict_and_records(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"case_id": 1, "system": "agentic", "llm_response": "x"}\n\n{"case_id": 2}\n')
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"case_id": 1}\n{oops\n')
    assert files.read_jsonl(spark, str(good), files.RESPONSE_SCHEMA).count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), files.RESPONSE_SCHEMA).collect()
    with pytest.raises(FileNotFoundError):
        files.read_jsonl(spark, str(tmp_path / "none.jsonl"), files.RESPONSE_SCHEMA)
    with pytest.warns(UserWarning):
        r = files.read_records(spark, {"single_tool": str(tmp_path / "none.jsonl"), "agentic": str(good)})
    assert r.select("source_system").distinct().collect()[0][0] == "agentic"


def test_jsonl_keeps_nulls_and_summary_doc(spark, tmp_path):
    v = fx.responses(spark, SF_SMALL)
    p = str(tmp_path / "resp")
    files.write_jsonl(v.limit(3), p)
    line = open([os.path.join(p, f) for f in sorted(os.listdir(p)) if f.endswith(".json")][0]).readline()
    assert "null" in line or '"agent_plan"' in line
    back = files.read_jsonl(spark, p, files.RESPONSE_SCHEMA)
    scores = S.score_v2(records.normalise(back), lists_as_text=False)
    sp = str(tmp_path / "summary")
    files.write_summary_json(summary.summarize_v2(scores), sp)
    txt = "".join(open(os.path.join(sp, f)).read() for f in os.listdir(sp) if f.startswith("part-"))
    doc = json.loads(txt)
    assert set(doc) <= {"agentic", "single_tool"} and "total_cases" in next(iter(doc.values()))


def test_read_series_date_alias(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("DATE,temperature,dew_point,wind_speed\n2005-01-01 00:00:00,1,2,3\n")
    s = files.read_series(spark, str(p)).first()
    assert s["temperature"] == 1.0 and str(s["date"]) == "2005-01-01 00:00:00"
    q = tmp_path / "t.csv"
    q.write_text("when,temperature\n1,2\n")
    with pytest.raises(ValueError):
        files.read_series(spark, str(q))


def test_raw_report_csv(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text("STATION,DATE,HourlyDryBulbTemperature,HourlyDewPointTemperature,HourlyWindSpeed\n"
                 "x,2005-01-01T00:51:00,30,20s,5\nx,2005-01-01T00:55:00,31,,6\n")
    from hourglass.operators import clean
    out = clean.clean_hourly(files.read_raw_reports(spark, str(p))).collect()
    assert out == []  # dew point never numeric in that hour -> the hour is dropped


def test_linear_model_save_load(spark, tmp_path):
    s = fx.series(spark, SF_SMALL)
    frame = forecast.training_frame(s)
    m = forecast.fit(frame.where("split = 'train'"), "linear")
    p = str(tmp_path / "model")
    forecast.save(m, p)
    m2 = forecast.load(p)
    a = forecast.predict(m, frame.where("split = 'test'")).select("sample_idx", "p_temperature")
    b = forecast.predict(m2, frame.where("split = 'test'")).select("sample_idx", "p_temperature")
    assert a.exceptAll(b).count() == 0 and a.count() == 385 - int(385 * 0.8)


def test_streaming_hourly_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(os.path.join(SF_SMALL, "events.parquet"), src / "part-0.parquet")
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).parquet(str(src))
    raw = stream.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("date"),
        F.when(F.col("event_type") == "error", F.concat(F.col("value").cast("string"), F.lit("s")))
        .otherwise(F.col("value").cast("string")).alias("temperature"),
        F.get_json_object("props", "$.k").alias("dew_point"),
        (F.col("user_id") % 40).cast("string").alias("wind_speed"))
    q = (hourly.hourly_stream(raw, tie_cols=["event_id"]).writeStream.outputMode("append").format("memory")
         .queryName("hourly_stream_test").option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("hourly_stream_test")
    batch = fx.series(spark, SF_SMALL, with_idx=False)
    assert got.count() > 0
    assert got.exceptAll(batch).count() == 0   # every emitted hour equals the batch answer


def test_streaming_scores(spark, tmp_path):
    d = tmp_path / "resp"
    files.write_jsonl(fx.responses(spark, SF_SMALL), str(d))
    stream = spark.readStream.schema(files.RESPONSE_SCHEMA).json(str(d))
    q = (hourly.score_stream(stream).writeStream.format("memory").queryName("score_stream_test")
         .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.table("score_stream_test").count() == 3000


def test_model_cases_verify_and_requests(spark):
    from hourglass.operators import requests as R, sampling
    s = fx.series(spark, SF_SMALL)
    m = forecast.fit(forecast.training_frame(s).where("split = 'train'"), "forest", numTrees=5, maxDepth=4)
    v = forecast.verify_model(m, s).first()
    assert v["test_examples"] == (480 - 96) - int((480 - 96) * 0.8)
    chk = forecast.single_forecast_check(m, s).collect()
    assert len(chk) == 1 and chk[0]["request_time"] is not None
    samples = sampling.even_positions(sampling.series_lengths(s), 50)
    cases = forecast.model_eval_cases(m, samples, s)
    assert cases.count() == samples.count()
    # same request alignment and statuses as the persistence lookup
    req = fx.requests(spark, SF_SMALL, s)
    a = forecast.model_requests(m, req, s).select("request_time", "status")
    b = R.request_lookup(req, s).select("request_time", "status")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_strict_series_parse_fails_on_bad_time(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("date,temperature,dew_point,wind_speed\nnot a time,1,2,3\n")
    with pytest.raises(Exception):
        files.read_series(spark, str(p)).collect()
    assert files.read_series(spark, str(p), strict=False).first()["date"] is None


def test_single_score_csv_layout(spark, tmp_path):
    from hourglass.operators import records as R
    rec = files.read_jsonl(spark, os.path.join(os.path.dirname(__file__), "data", "single_response.jsonl"),
                           files.RESPONSE_SCHEMA)
    sc = S.score_single(R.normalise(rec))
    p = str(tmp_path / "single_csv")
    assert files.write_csv(sc, p, columns=files.SINGLE_SCORE_COLUMNS, python_bools=True)
    part = [f for f in os.listdir(p) if f.startswith("part-") and f.endswith(".csv")]
    text = "".join(open(os.path.join(p, f)).read() for f in part)
    header, row = text.split("\n", 1)
    assert header.split(",") == files.SINGLE_SCORE_COLUMNS
    assert row.startswith("2005-04-12 08:00:00,2005-04-13 08:00:00,2005-04-13 08:00:00,True,57.39,57.39,True,")
    assert ",actual;absolute error,False,True,True," in row
    assert not files.write_csv(sc.where("false"), str(tmp_path / "empty"), skip_empty=True)
    assert not os.path.exists(str(tmp_path / "empty"))


def test_single_score_csv_golden_bytes(spark, tmp_path):
    from hourglass.operators import records as R
    data = os.path.join(os.path.dirname(__file__), "data")
    rec = files.read_jsonl(spark, os.path.join(data, "single_response.jsonl"), files.RESPONSE_SCHEMA)
    sc = S.score_single(R.normalise(rec)).coalesce(1)
    p = str(tmp_path / "golden_csv")
    files.write_csv(sc, p, columns=files.SINGLE_SCORE_COLUMNS, python_bools=True)
    part = [f for f in os.listdir(p) if f.startswith("part-") and f.endswith(".csv")][0]
    ours = open(os.path.join(p, part), encoding="utf-8").read()
    assert ours == open(os.path.join(data, "single_scores.csv"), encoding="utf-8").read()


def test_single_score_jsonl_golden_bytes(spark, tmp_path):
    from hourglass.operators import records as R
    data = os.path.join(os.path.dirname(__file__), "data")
    rec = files.read_jsonl(spark, os.path.join(data, "single_response.jsonl"), files.RESPONSE_SCHEMA)
    sc = S.score_single(R.normalise(rec)).coalesce(1)
    p = str(tmp_path / "golden_jsonl")
    files.write_jsonl(sc, p, python_compatible=True, columns=files.SINGLE_SCORE_COLUMNS)
    part = [f for f in os.listdir(p) if f.startswith("part-")][0]
    ours = open(os.path.join(p, part), encoding="utf-8").read()
    assert ours == open(os.path.join(data, "single_scores.jsonl"), encoding="utf-8").read()


def test_python_json_escapes(spark):
    from hourglass.functions.answers import python_json_line
    vals = ['a"b\\c', "tab\there\nnew", "°F ok", "emoji \U0001F600", "", None]
    df = spark.createDataFrame([(v, [v or "x"], True, 1.5) for v in vals], "s string, l array<string>, b boolean, d double")
    got = [r[0] for r in df.select(python_json_line(df)).collect()]
    exp = [json.dumps({"s": v, "l": [v or "x"], "b": True, "d": 1.5}) for v in vals]
    assert got == exp


def test_flat_case_csv_golden_bytes(spark, tmp_path):
    from hourglass.operators import requests as R
    data = os.path.join(os.path.dirname(__file__), "data")
    cases = files.read_jsonl(spark, os.path.join(data, "eval_cases_50.jsonl"), files.CASE_SCHEMA)
    p = str(tmp_path / "flat_csv")
    files.write_csv(R.flatten_case(cases).orderBy("case_id").coalesce(1), p)
    part = [f for f in os.listdir(p) if f.startswith("part-") and f.endswith(".csv")][0]
    ours = open(os.path.join(p, part), encoding="utf-8").read()
    assert ours == open(os.path.join(data, "eval_cases_50.csv"), encoding="utf-8").read()


def test_nested_case_jsonl_golden_bytes(spark, tmp_path):
    data = os.path.join(os.path.dirname(__file__), "data")
    cases = files.read_jsonl(spark, os.path.join(data, "eval_cases_50.jsonl"), files.CASE_SCHEMA)
    p = str(tmp_path / "cases_jsonl")
    files.write_jsonl(cases.orderBy("case_id").coalesce(1), p, python_compatible=True)
    part = [f for f in os.listdir(p) if f.startswith("part-")][0]
    ours = open(os.path.join(p, part), encoding="utf-8").read()
    assert ours == open(os.path.join(data, "eval_cases_50.jsonl"), encoding="utf-8").read()


def test_release_scratch_removes_only_own_tables(spark):
    from hourglass.session import materialize, release_scratch, _SCRATCH
    before = list(_SCRATCH)
    t = materialize(fx.series(spark, SF_SMALL, with_idx=False), "scratch-test")
    assert t.count() == 480
    n = release_scratch(spark)
    assert n >= 1 and _SCRATCH == []


def _layout_frame(spark, records, first_key=None):
    """A DataFrame holding the given dicts' values with their key order and JSON types."""
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
    keys = list(records[0].keys())
    kind = lambda v: StringType() if isinstance(v, str) else LongType() if isinstance(v, int) else DoubleType()
    fields = ([StructField(first_key, StringType())] if first_key else []) + \
        [StructField(k, kind(records[0][k])) for k in keys]
    return spark.createDataFrame([tuple(r.values()) if not first_key else (r["__key"], *[r[k] for k in keys if k != "__key"])
                                  for r in records], StructType([f for f in fields if f.name != "__key"]))


def _read_text(p):
    part = [f for f in os.listdir(p) if f.startswith("part-")][0]
    return open(os.path.join(p, part), encoding="utf-8").read().rstrip("\n")


def test_summary_json_layouts(spark, tmp_path):
    """Documents rendered from the committed summaries' own values reproduce their bytes."""
    data = os.path.join(os.path.dirname(__file__), "data")
    flat_text = open(os.path.join(data, "accuracy_summary_layout.json"), encoding="utf-8").read()
    flat = json.loads(flat_text)
    p = str(tmp_path / "flat")
    files.write_summary_json(_layout_frame(spark, [flat]), p, key=None, pretty=True)
    assert _read_text(p) == flat_text
    nested_text = open(os.path.join(data, "system_summary_layout.json"), encoding="utf-8").read()
    nested = json.loads(nested_text)
    rows = [{"__key": k, **v} for k, v in nested.items()]
    metrics = list(next(iter(nested.values())).keys())
    df = spark.createDataFrame(
        [(r["__key"], *[r[m] for m in metrics]) for r in rows],
        ", ".join(["system string"] + [f"{m} {'bigint' if isinstance(rows[0][m], int) else 'double'}" for m in metrics]))
    q = str(tmp_path / "nested")
    files.write_summary_json(df, q, key="system", pretty=True)
    assert _read_text(q) == nested_text


def test_summary_csv_layouts_crlf(spark, tmp_path):
    """Summary CSVs rendered from the committed summaries' values reproduce their bytes (CRLF lines)."""
    data = os.path.join(os.path.dirname(__file__), "data")
    flat = json.loads(open(os.path.join(data, "accuracy_summary_layout.json"), encoding="utf-8").read())
    p = str(tmp_path / "flat_csv")
    files.write_csv(_layout_frame(spark, [flat]), p, line_sep="\r\n")
    part = [f for f in os.listdir(p) if f.startswith("part-")][0]
    assert open(os.path.join(p, part), "rb").read() == open(os.path.join(data, "accuracy_summary_layout.csv"), "rb").read()
    nested = json.loads(open(os.path.join(data, "system_summary_layout.json"), encoding="utf-8").read())
    metrics = list(next(iter(nested.values())).keys())
    df = spark.createDataFrame(
        [(k, *[v[m] for m in metrics]) for k, v in nested.items()],
        ", ".join(["system string"] + [f"{m} {'bigint' if isinstance(next(iter(nested.values()))[m], int) else 'double'}"
                                       for m in metrics]))
    q = str(tmp_path / "nested_csv")
    files.write_csv(df, q, line_sep="\r\n")
    part = [f for f in os.listdir(q) if f.startswith("part-")][0]
    assert open(os.path.join(q, part), "rb").read() == open(os.path.join(data, "system_summary_layout.csv"), "rb").read()
