"""Header catalogue, run log, late reports, range positions, lag moments, time ranges, bad lines."""

import datetime as dt
import gzip
import json
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hourglass.operators import clean, forecast, moments, position, requests, windows
from hourglass.sources import files, storage
from hourglass.sources import fixtures as fx
from hourglass.sources.runlog import RunLog
from hourglass.streaming.collapse import HourlyLog

T0 = dt.datetime(2024, 5, 1)


# --- files of several headers

def write_reports(folder):
    (folder / "a.csv").write_text("STATION,DATE,HourlyDryBulbTemperature,HourlyDewPointTemperature,HourlyWindSpeed\nx,2005-01-01T00:51:00,50,40,3\nx,2005-01-01T01:51:00,51,41,4\n")
    (folder / "b.csv").write_text("\ufeffHourlyWindSpeed,DATE,HourlyDewPointTemperature,REM,HourlyDryBulbTemperature\n5,2005-01-01T02:51:00,41,\"a, b\",51\n")
    with gzip.open(folder / "c.csv.gz", "wt") as out:
        out.write("DATE,HourlyDewPointTemperature,HourlyDryBulbTemperature,HourlyWindSpeed\n2005-01-01T03:51:00,42,52s,6\n")
    (folder / "empty.csv").write_text("")
    (folder / "_ignored.csv").write_text("nothing\n1\n")


def test_columns_are_found_by_name_in_each_file(spark, tmp_path):
    write_reports(tmp_path)
    got = sorted(tuple(r) for r in files.read_raw_reports(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    want = con.execute(f"""SELECT DATE, HourlyDryBulbTemperature, HourlyDewPointTemperature, HourlyWindSpeed FROM read_csv(
        ['{tmp_path}/a.csv', '{tmp_path}/b.csv', '{tmp_path}/c.csv.gz'], union_by_name=true, all_varchar=true)""").fetchall()
    assert got == sorted(want) and len(got) == 4
    catalogue = storage.header_catalogue(spark, [f"{tmp_path}/*.csv", f"{tmp_path}/*.gz"])
    assert len(catalogue) == 4 and all(len(v) == 1 for v in catalogue.values())   # the glob names _ignored.csv itself


def test_many_files_of_one_header_are_one_scan(spark, tmp_path):
    for k in range(30):
        order = "DATE,temperature,dew_point,wind_speed" if k % 2 else "wind_speed,date,dew_point,temperature"
        row = f"2005-01-{k % 28 + 1:02d} 0{k // 28}:00:00,{k},2,3" if k % 2 else f"3,2005-01-{k % 28 + 1:02d} 0{k // 28}:00:00,2,{k}"
        (tmp_path / f"{k}.csv").write_text(f"{order}\n{row}\n")
    df = files.read_series(spark, str(tmp_path))
    assert sorted(r.temperature for r in df.collect()) == list(map(float, range(30)))
    assert {(r.dew_point, r.wind_speed) for r in df.collect()} == {(2.0, 3.0)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_a_file_without_a_column_is_named(spark, tmp_path):
    write_reports(tmp_path)
    (tmp_path / "d.csv").write_text("DATE,HourlyDewPointTemperature,HourlyWindSpeed,HourlyWindSpeed\n2005-01-01T04:51:00,1,2,3\n")
    with pytest.raises(ValueError, match="d.csv lacks columns .*HourlyDryBulbTemperature"):
        files.read_raw_reports(spark, str(tmp_path))
    row = files.read_raw_reports(spark, str(tmp_path), fill_missing=True).where("date like '%T04%'").first()
    assert (row.temperature, row.wind_speed) == (None, "2")   # the first of two columns of a name
    with pytest.raises(FileNotFoundError):
        files.read_raw_reports(spark, str(tmp_path / "none"))


# --- bad lines

def test_bad_lines_are_named_by_file_and_line(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "good.jsonl").write_text("".join(json.dumps({"case_id": k, "system": "agentic"}) + "\n" for k in range(50)))
    lines = [json.dumps({"case_id": k, "llm_response": "x" * (k % 90)}) for k in range(3000)]
    lines[7] = ""
    lines[1234], lines[2999] = '{"case_id": 12', '{"case_id": "many"}'
    (folder / "bad.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")   # the file is read in many splits
    try:
        found = sorted((r.file.rsplit("/", 1)[-1], r.line, r.text) for r in files.bad_lines(spark, str(folder), files.RESPONSE_SCHEMA).collect())
        assert found == [("bad.jsonl", 1235, lines[1234]), ("bad.jsonl", 3000, lines[2999])]
        with pytest.raises(ValueError, match="bad.jsonl:1235: .*bad.jsonl:3000"):
            files.check_jsonl(spark, str(folder), files.RESPONSE_SCHEMA)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for use in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("system").collect()):
        with pytest.raises(Exception, match="malformed JSON line in .*bad.jsonl"):
            use(files.read_jsonl(spark, str(folder), files.RESPONSE_SCHEMA))
    assert files.read_jsonl(spark, str(folder / "good.jsonl"), files.RESPONSE_SCHEMA).count() == 50
    files.check_jsonl(spark, str(folder / "good.jsonl"), files.RESPONSE_SCHEMA)


# --- run log

def numbers(spark, *values):
    return spark.createDataFrame([(v, None) for v in values], "v long, s string")


def values_of(log):
    return sorted(r.v for r in log.read().collect())


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_run_log_survives_retries(spark, tmp_path, fmt):
    log = RunLog(spark, f"file://{tmp_path}/log", "v long, s string", fmt)
    assert values_of(log) == [] and log.vacuum() == 0
    log.append(numbers(spark, 1, 2), "a")
    log.append(numbers(spark, 3), "b/ c")
    log.append(numbers(spark, 1, 2), "a")          # the same run again
    assert values_of(log) == [1, 2, 3]
    log._write(numbers(spark, 99))                 # killed after its files, before its commit
    with pytest.raises(Exception):                 # killed while writing
        log.append(numbers(spark, 98).withColumn("v", F.raise_error(F.lit("killed")).cast("long")), "d")
    assert values_of(log) == [1, 2, 3]
    log.append(numbers(spark, 4), "d")
    log.append(numbers(spark, 7, 8), "a")          # replaced by other rows
    assert values_of(log) == [3, 4, 7, 8] and sorted(r.v for r in log.read(["a"]).collect()) == [7, 8]
    assert log.vacuum() >= 3 and values_of(log) == [3, 4, 7, 8]
    storage.create_text(spark, f"{tmp_path}/log/ledger/{99:012d}", '{"a": "half a ver')   # a version that was not written to its end
    assert values_of(log) == [3, 4, 7, 8]
    log.fold("all", lambda df: df.where("v > 3"))
    assert list(log.runs()) == ["all"] and values_of(log) == [4, 7, 8]


def test_run_log_writers_at_once(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/log", "v long, s string")
    frames = [numbers(spark, k) for k in range(8)]
    threads = [threading.Thread(target=lambda k=k: log.append(frames[k], f"run-{k}")) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert values_of(log) == list(range(8))


# --- late reports

def reports(seed=3, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        at = T0 + dt.timedelta(seconds=int(rng.integers(0, 3600 * 30)))
        if k % 5 == 0 and rows:
            at = dt.datetime.fromisoformat(rows[-1][0])   # equal times
        value = lambda: [None, "NaN", "7s", str(int(rng.integers(-5, 90)))][min(3, int(rng.integers(0, 12)))]
        rows.append((at.isoformat(), k, value(), value(), value(), "ab"[k % 2]))
    return rows + [("no time", n, "1", "2", "3", "a"), (None, n + 1, "1", "2", "3", "a")]


FORM = "date string, event_id long, temperature string, dew_point string, wind_speed string, station string"


@pytest.mark.parametrize("order,parts", [("as is", 1), ("as is", 7), ("backwards", 5), ("shuffled", 23)])
def test_late_reports_give_the_batch_result(spark, tmp_path, order, parts):
    rows = reports()
    want = sorted(tuple(r) for r in clean.clean_hourly(spark.createDataFrame(rows, FORM), keys=["station"], tie_cols=["event_id"]).collect())
    if order != "as is":
        rows = rows[::-1] if order == "backwards" else [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    log = HourlyLog(spark, f"{tmp_path}/log", tie_cols=["event_id"], keys=["station"], fold_every=4)
    batches = [spark.createDataFrame(rows[lo::parts], FORM) for lo in range(parts)]
    for k, batch in enumerate(batches):
        log.upsert(batch, k)
        if k % 3 == 1:
            log.upsert(batch, k)        # retried
        if k % 4 == 0 and k:
            log.upsert(batches[0], 0)   # long folded in, and run again
    assert sorted(tuple(r) for r in log.table().collect()) == want and want
    log.fold()
    assert sorted(tuple(r) for r in log.table().collect()) == want
    assert log.log.read().count() == log.table(drop_incomplete=False).count()


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = reports(n=100)
    folder = tmp_path / "in"
    folder.mkdir()
    def drop(name, part):
        (folder / name).write_text("".join(json.dumps(dict(zip(("date", "event_id", "temperature", "dew_point", "wind_speed", "station"), r))) + "\n" for r in part))
    log = HourlyLog(spark, f"{tmp_path}/log", tie_cols=["event_id"])
    stream = lambda: spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).json(str(folder))
    drop("1.json", rows[50:])
    first = log.run(stream(), f"{tmp_path}/checkpoint").table().count()
    drop("2.json", rows[:50])   # earlier hours, long passed
    got = sorted(tuple(r) for r in log.run(stream(), f"{tmp_path}/checkpoint").table().collect())
    assert got == sorted(tuple(r) for r in clean.clean_hourly(spark.createDataFrame(rows, FORM), tie_cols=["event_id"]).collect())
    assert first < len(got)


# --- range positions

def test_a_hot_day_is_cut_like_any_other(spark):
    """Nine tenths of the rows in one day: every range holds about as many rows as the median, and positions are right."""
    rows = [(T0 + dt.timedelta(seconds=k * 4 if k < 18000 else 86400 + (k - 18000) * 4000), k) for k in range(20_000)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, v long").repartition(7, "v")
    ranged = position.ranged_rows(df, ["date"], ranges=16)
    sizes = sorted(r.rows for r in position.zone_map(ranged, "date").collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    got = position.range_positions(df, ["date"], ranges=16)
    assert sorted((r.v, r.idx, r.n) for r in got.collect()) == [(k, k, 20_000) for k in range(20_000)]
    zones = sorted((r["first"], r["last"]) for r in position.zone_map(ranged, "date").collect())
    assert all(a[1] < b[0] for a, b in zip(zones, zones[1:]))


def test_range_positions_of_keys_nulls_and_nothing(spark):
    rows = [(k % 3 if k % 7 else None, T0 + dt.timedelta(minutes=(k * 37) % 1000) if k else None, k) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, date timestamp_ntz, v long")
    got = position.range_positions(df, ["date", "v"], ["k"], ranges=5)
    want = position.with_position_global(df, ["date", "v"], ["k"])
    assert sorted(map(str, (tuple(r) for r in got.select("k", "v", "idx").collect()))) == sorted(map(str, (tuple(r) for r in want.select("k", "v", "idx").collect())))
    sizes = {r.k: r.c for r in df.groupBy("k").agg(F.count("*").alias("c")).collect()}
    assert all(r.n == sizes[r.k] for r in got.collect())
    assert position.range_positions(df.where("false"), ["date"]).count() == 0


# --- lag moments

def walk(n, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 3)).cumsum(0) + [50.0, 40.0, 5.0]


def series_of(spark, x):
    rows = [(T0 + dt.timedelta(hours=k), *map(float, v), k, len(x)) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "date timestamp_ntz, temperature double, dew_point double, wind_speed double, idx long, n long")


def by_hand(x, window, horizon, ratio=0.8):
    """(all windows with intercept, targets, training windows, coefficients) by numpy."""
    n = len(x) - window - horizon + 1
    a = np.hstack([np.array([x[i:i + window].reshape(-1) for i in range(n)]), np.ones((n, 1))])
    y = x[window + horizon - 1:]
    m = int(n * ratio)
    return a, y, m, np.linalg.lstsq(a[:m], y[:m], rcond=None)[0]


@pytest.mark.parametrize("n,window,horizon,chunk", [(400, 5, 3, 50), (400, 5, 3, 10_000), (300, 12, 24, 37), (60, 1, 1, 10)])
def test_moments_equal_built_windows(spark, n, window, horizon, chunk):
    x = walk(n)
    s = series_of(spark, x).repartition(3)
    a, y, m, w = by_hand(x, window, horizon)
    g, xy, sx, sy = moments.window_moments(s, ["temperature", "dew_point", "wind_speed"], 0.0, m, window, horizon, chunk=chunk)
    p = 3 * window
    assert np.allclose(g.transpose(0, 2, 1, 3).reshape(p, p), a[:m, :p].T @ a[:m, :p], rtol=1e-10)
    assert np.allclose(xy.reshape(p, 3), a[:m, :p].T @ y[:m], rtol=1e-10)
    assert np.allclose(sx.reshape(p), a[:m, :p].sum(0)) and np.allclose(sy, y[:m].sum(0))
    model = moments.fit_linear(s, window=window, horizon=horizon, chunk=chunk)
    got = moments.predict_linear(s, model, chunk=chunk).orderBy("sample_idx").toPandas()
    assert np.allclose(got[["p_temperature", "p_dew_point", "p_wind_speed"]], a @ w, atol=1e-6)
    assert np.allclose(got[["y_temperature", "y_dew_point", "y_wind_speed"]], y) and list(got.sample_idx) == list(range(len(y)))


def test_moments_without_full_rank(spark):
    """A constant column and fewer windows than inputs: still the least squares."""
    x = walk(80)
    x[:, 2] = 7.0
    s = series_of(spark, x)
    a, y, m, _ = by_hand(x, 30, 2)
    got = moments.predict_linear(s, moments.fit_linear(s, window=30, horizon=2)).orderBy("sample_idx").toPandas()
    p = got[["p_temperature", "p_dew_point", "p_wind_speed"]].to_numpy()
    assert np.allclose(p[:m], y[:m], atol=1e-4) and np.allclose(p[:, 2], 7.0)
    with pytest.raises(ValueError):
        moments.fit_linear(s, window=72, horizon=24)


def test_moments_equal_the_estimator_on_the_test_tables(spark):
    s = fx.series(spark, "/root/testdata/sf0.01")
    a = forecast.model_forecast(s, kind="linear", window=24).orderBy("sample_idx").toPandas()
    b = moments.predict_linear(s, moments.fit_linear(s, window=24)).where(F.col("sample_idx") >= int(a.sample_idx.min())).orderBy("sample_idx").toPandas()
    assert list(a.sample_idx) == list(b.sample_idx)
    for m in ("temperature", "dew_point", "wind_speed"):
        assert np.allclose(a[f"p_{m}"], b[f"p_{m}"], atol=1e-5)


# --- time ranges

def test_time_ranges_read_only_the_days_they_need(spark, tmp_path):
    s = fx.series(spark, SF_SMALL, with_idx=False)
    path = str(tmp_path / "history")
    requests.write_history(s, path)
    spans = spark.createDataFrame([(1, dt.datetime(2024, 1, 3, 22), dt.datetime(2024, 1, 5, 2)), (2, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5)),
                                   (3, dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 8)), (4, None, dt.datetime(2024, 1, 8)),
                                   (5, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2))], "id long, start timestamp_ntz, end timestamp_ntz")
    got = requests.time_ranges(spans, requests.read_history(spark, path))
    rows = [r.date for r in s.collect()]
    want = sorted((r.id, d) for r in spans.collect() for d in rows if r.start and r.start <= d <= r.end)
    assert sorted((r.id, r.date) for r in got.collect()) == want and len(want) >= 20
    spark.createDataFrame([(1, dt.datetime(2024, 1, 3))], "id long, start timestamp_ntz").write.parquet(str(tmp_path / "spans"))
    picked = spark.read.parquet(str(tmp_path / "spans")).where("id = 1").withColumn("end", F.col("start"))
    plan = requests.time_ranges(picked, requests.read_history(spark, path))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text


# --- a series stored for its windows

def panel_of_a_hot_key(spark):
    rows = [(k, T0 + dt.timedelta(hours=h), float(h % 17 + (k or 0))) for k, n in ((1, 900), (2, 40), (None, 90)) for h in range(n) if h % 11]
    return position.with_position(spark.createDataFrame(rows, "k int, date timestamp_ntz, v double"), ["date"], keys=["k"])


def test_a_stored_series_gives_what_the_series_gives(spark):
    s = panel_of_a_hot_key(spark)
    store = windows.laid_out(s, ["k"], chunk=100)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for f in (lambda x: requests.forecast_frame(x, ["v"], ["k"]), lambda x: windows.persistence(x, ["v"], ["k"]), lambda x: windows.step_sizes(x, ["k"]),
              lambda x: windows.verify_windows(x, ["v"], ["k"]), lambda x: windows.train_windows(x, ["v"], ["k"]),
              lambda x: windows.history_counts(x, ["k"]).select("k", "date", "history_rows", "history_complete")):
        plain, stored = f(s), f(store)
        assert rows(stored) == rows(plain) and plain.count() > 0
        assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in store.df.where("k = 1").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 0.8 * sum(sizes)


def test_a_stored_series_refuses_more_than_it_holds(spark):
    s = panel_of_a_hot_key(spark)
    store = windows.laid_out(s.where("k = 2"), ["k"], back=10, forward=2, chunk=20)
    for wrong in (lambda: windows.persistence(store, ["v"], ["k"]), lambda: windows.history_counts(store, ["k"], hours=11),
                  lambda: requests.forecast_frame(store, ["v"], ["k"]), lambda: windows.step_sizes(store)):
        with pytest.raises(ValueError, match="does not serve"):
            wrong()
    assert windows.laid_out(s.where("false"), ["k"]).df.count() == 0
