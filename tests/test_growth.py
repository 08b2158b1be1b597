"""Work that must grow no faster than the rows: written logs, tree fits."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from hourglass import session
from hourglass.operators import forecast
from hourglass.sources import files
from hourglass.sources.runlog import RunLog


def data_files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")]


def records(spark, n=3000):
    m = F.struct(*[(F.col("id") + F.lit(k / 10)).alias(c) for k, c in enumerate(forecast.MEASURES)])
    return spark.range(n).select(F.col("id").alias("case_id"), F.lit("agentic").alias("system"), m.alias("prediction"), m.alias("actual"),
                                 F.when(F.col("id") % 7 > 0, F.concat(F.lit("It is 20 °F at "), F.col("id"))).alias("llm_response"))


def test_gzipped_jsonl_is_small_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(files.GZIP, "maxRecordsPerFile", "1000")
    plain, packed, log = str(tmp_path / "plain"), str(tmp_path / "packed"), RunLog(spark, str(tmp_path / "log"), files.RESPONSE_SCHEMA, "json")
    r = records(spark).coalesce(1)
    files.write_jsonl(r, plain)
    files.write_jsonl(r.where("case_id % 2 = 0"), packed, mode="append", gzip=True)
    files.write_jsonl(r.where("case_id % 2 = 1"), packed, mode="append", gzip=True)
    log.append(r, "a")
    size = sum(map(os.path.getsize, data_files(plain)))
    want = sorted(map(str, files.read_jsonl(spark, plain, files.RESPONSE_SCHEMA).collect()))
    for folder, back, most in ((packed, files.read_jsonl(spark, packed, files.RESPONSE_SCHEMA), 4), (tmp_path / "log" / "data", log.read(), 3)):
        assert sorted(map(str, back.collect())) == want and len(want) == 3000
        found = data_files(folder)
        assert sum(map(os.path.getsize, found)) < size / 4 and len(found) == most and all(f.endswith(".json.gz") for f in found)


def test_logs_of_queries_are_gzipped(spark):
    for name in ("run_log", "file_records", "stream_score_v2"):
        before = len(session._SCRATCH)
        E.queries()[name](spark, SF_SMALL)
        found = [f for folder in session._SCRATCH[before:] for f in data_files(folder) if ".json" in f]
        assert found and all(f.endswith(".json.gz") for f in found), name


def training(spark, n=60):
    v = F.array(*[F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(1000)).cast("double") for k in range(6)])
    rows = spark.range(n).select(F.col("id").alias("sample_idx"), forecast.array_to_vector(v).alias("features"),
                                 *[(v[k] + v[k + 3]).alias(f"y_{m}") for k, m in enumerate(forecast.MEASURES)])
    return rows


def test_a_forest_is_fitted_in_partitions_by_rows(spark, monkeypatch):
    rows = training(spark)
    found = []
    for parts in (2, 40):      # however the session deals them, empty partitions included
        model = forecast.fit(rows.repartition(parts, "sample_idx"), "forest", numTrees=3, maxDepth=4)
        found.append(sorted(map(str, forecast.predict(model, rows).drop("features").collect())))
    assert found[0] == found[1] and len(found[0]) == 60
    dealt, n = forecast._dealt(rows.repartition(40, "sample_idx"))
    assert n == dealt.rdd.getNumPartitions() == 1 and dealt.count() == 60
    monkeypatch.setattr(forecast, "ROWS_PER_TASK", 20)
    dealt, n = forecast._dealt(rows)
    assert n == dealt.rdd.getNumPartitions() == 3 and sorted(dealt.rdd.glom().map(len).collect())[0] > 0 and dealt.count() == 60


def test_csv_files_are_one_task_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROWS_PER_FILE", 1000)
    r = spark.range(2500).coalesce(1).select("id", F.concat(F.lit("two\nlines, "), F.col("id")).alias("text"))
    files.write_csv(r, str(tmp_path / "csv"))
    back = files.read_scores_csv(spark, str(tmp_path / "csv"), "id long, text string")
    assert len(data_files(tmp_path / "csv")) == 3 and sorted(back.collect()) == r.collect()
