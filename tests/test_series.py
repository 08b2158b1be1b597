"""Cleaning, positions and windows: fixture sizes, halo-chunk equality, plan shape."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from hourglass.operators import clean, position, windows as W
from hourglass.sources import fixtures as fx


def test_series_sizes(spark):
    assert fx.series(spark, SF_SMALL).count() == 480
    assert fx.series(spark, SF_MID).count() == 720


def test_panel_training_windows(spark):
    p = fx.panel(spark, SF_SMALL)
    assert W.train_windows(p, fx.PANEL_MEASURES, keys=["l_suppkey"], arrays=False).count() == 4384


def test_window_counts(spark):
    s = fx.series(spark, SF_MID)
    n = 720
    assert W.train_windows(s, arrays=False).count() == n - 95
    assert W.verify_windows(s, arrays=False).count() == n - 96
    sp = W.time_split(W.train_windows(s, arrays=False)).groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in sp}
    assert counts["train"] == int((n - 95) * 0.8)


def test_last_per_hour_skips_nulls(spark):
    rows = [("2024-01-01 00:10:00", "1", "5", "7", 1), ("2024-01-01 00:50:00", "2s", "6", None, 2),
            ("2024-01-01 01:05:00", "M", "1", "1", 3), ("bad", "9", "9", "9", 4)]
    df = spark.createDataFrame(rows, "date string, temperature string, dew_point string, wind_speed string, eid int")
    out = clean.clean_hourly(df, tie_cols=["eid"]).orderBy("date").collect()
    assert len(out) == 1   # hour 01 has no temperature -> dropped; bad date dropped
    assert (out[0]["temperature"], out[0]["dew_point"], out[0]["wind_speed"]) == (1.0, 6.0, 7.0)


def test_lenient_number(spark):
    vals = ["57", " 57.5 ", "57d", "57f", "NaN", "Infinity", "1e3", "-.5", "", "abc", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(clean.lenient_number(F.col("v"))).collect()]
    assert got == [57.0, 57.5, None, None, None, None, 1000.0, -0.5, None, None, None]


def test_position_buckets_equal_global(spark):
    s = fx.series(spark, SF_SMALL, with_idx=False)
    a = position.with_position(s, ["date"], bucket=F.date_trunc("hour", "date")).select("date", "idx")
    b = position.with_position_global(s, ["date"]).select("date", "idx")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_small_chunks_equal_one_chunk(spark):
    """Halo copies make every frame complete: many tiny chunks give the one-chunk answer."""
    s = fx.series(spark, SF_MID)
    cols = ["idx", "x_size", "target_date", "y_temperature"]
    big = W.verify_windows(s, chunk=1_000_000).select(*cols, F.to_json("x").alias("x"))
    small = W.verify_windows(s, chunk=100).select(*cols, F.to_json("x").alias("x"))
    assert big.count() == 624
    assert big.exceptAll(small).count() == 0 and small.exceptAll(big).count() == 0
    p1 = W.persistence(s, chunk=1_000_000)
    p2 = W.persistence(s, chunk=30)
    assert p1.exceptAll(p2).count() == 0 and p1.count() == p2.count()


def test_history_small_chunks(spark):
    s = fx.series(spark, SF_SMALL, with_idx=False)
    a = W.history_counts(s, hours=72, chunk_hours=24 * 365)
    b = W.history_counts(s, hours=72, chunk_hours=100)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 480


def test_windowed_plan_has_no_single_partition_on_rows(spark, tmp_path):
    """On an indexed table, the window stage shuffles by (keys, chunk), never to one partition."""
    path = str(tmp_path / "series")
    fx.series(spark, SF_SMALL).write.parquet(path)
    s = spark.read.parquet(path)
    plan = W.train_windows(s)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "hashpartitioning(_chunk" in plan
    panel_plan = W.persistence(fx.panel(spark, SF_SMALL), fx.PANEL_MEASURES, keys=["l_suppkey"])._jdf \
        .queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey" in panel_plan


def test_hourly_scan_prunes_columns(spark):
    plan = fx.series(spark, SF_SMALL, with_idx=False)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan or "FileScan" in plan


def test_range_scan_reads_only_date(spark):
    from hourglass.operators import quality
    plan = quality.series_range(fx.series(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<date:timestamp_ntz>" in plan


def test_scoring_plan_has_no_shuffle(spark):
    from hourglass.functions import score as S
    from hourglass.operators import records
    plan = S.score_v2(records.normalise(fx.responses(spark, SF_SMALL)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_generator_loaded_once_per_task(spark):
    from hourglass.operators import answers
    calls = spark.sparkContext.accumulator(0)

    def factory():
        calls.add(1)          # stands for loading a model
        return lambda pdf: ["ok"] * len(pdf)

    c = fx.tool_output(fx.cases(spark, SF_SMALL)).repartition(4)
    out = answers.generate(c, "case_id", factory, parallelism=3)
    assert out.where("llm_response = 'ok'").count() == 1500
    assert calls.value == 3
