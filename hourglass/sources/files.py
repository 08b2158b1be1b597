"""File sources and sinks (SRC-1..8, SNK-1..6).

Readers take explicit schemas (no inference pass over the data) and only
select the columns a plan needs; writers stream from the tasks (no driver
collection).  CSV uses ``escape='"'`` both ways and ``multiLine`` on read so
text with quotes, commas and newlines round-trips; JSON keeps null fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

from ..functions import vocab
from ..operators.clean import RAW_RENAMES
from . import storage

MEASURES = vocab.MEASURES

#: Compressed or multi-line text cannot be split, so a file is one task's reading: at most so many rows go into one.
ROWS_PER_FILE = 250_000
#: Settings of a compressed JSONL sink; the fastest level makes a record about a ninth, for less than plain writing takes.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": str(ROWS_PER_FILE)}

_M = StructType([StructField(m, DoubleType()) for m in MEASURES])

CASE_SCHEMA = StructType([
    StructField("case_id", LongType()), StructField("request_time", StringType()),
    StructField("forecast_target_time", StringType()),
    StructField("prediction", _M), StructField("actual", _M), StructField("absolute_error", _M),
])

TOOL_SCHEMA = StructType([
    StructField("request_time", StringType()), StructField("forecast_target_time", StringType()),
    *[StructField(f"predicted_{m}", DoubleType()) for m in MEASURES],
])

RESPONSE_SCHEMA = StructType([
    StructField("run_timestamp", StringType()), StructField("system", StringType()),
    StructField("system_type", StringType()), StructField("model_path", StringType()),
    StructField("case_id", LongType()), StructField("request_time", StringType()),
    StructField("forecast_target_time", StringType()),
    StructField("tool_output", TOOL_SCHEMA), StructField("prediction", _M), StructField("actual", _M),
    StructField("absolute_error", _M), StructField("expected_prediction", _M),
    StructField("user_request", StringType()), StructField("agent_plan", StringType()),
    StructField("verification", StructType([
        StructField("verified", BooleanType()), StructField("missing_fields", ArrayType(StringType())),
        *[StructField(f, StringType()) for f in ("request_time", "forecast_target_time")],
        *[StructField(f"predicted_{m}", DoubleType()) for m in MEASURES],
    ])),
    StructField("final_response", StringType()), StructField("llm_response", StringType()),
])


def read_by_name(spark: SparkSession, paths, sep: str = ",") -> list[tuple[tuple[str, ...], DataFrame]]:
    """CSV files by header: (columns, frame of text columns) for each distinct header, one scan each.

    Every file's own first line names its columns, so files of other column
    orders, with more or fewer columns, never mix by position.  Of a name
    that a header has twice the first counts; the others are ``name.1`` and so on.
    """
    frames = []
    for header, names in storage.header_catalogue(spark, paths, sep).items():
        seen: dict[str, int] = {}
        columns = []
        for name in header:
            n = seen.get(name.lower(), 0)
            seen[name.lower()] = n + 1
            columns.append(f"{name}.{n}" if n else name)
        schema = StructType([StructField(c, StringType()) for c in columns])
        df = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(names)
        frames.append((tuple(columns), df))
    return frames


def _by_name(spark: SparkSession, path, columns: dict, fill_missing: bool = False) -> DataFrame:
    """The union of all headers' scans; ``columns``: name -> names in the files, the first that a header has is taken."""
    parts, lacking = [], {}
    for header, df in read_by_name(spark, path):
        picked = {name: next((c for c in among if c in header), None) for name, among in columns.items()}
        missing = [columns[name][0] for name, c in picked.items() if c is None]
        if missing and not fill_missing:
            lacking[df.inputFiles()[0]] = missing
        parts.append(df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in picked.items()]))
    if lacking:
        raise ValueError("; ".join(f"{file} lacks columns {missing}" for file, missing in lacking.items()))
    if not parts:
        raise ValueError(f"{path}: only empty files")
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_raw_reports(spark: SparkSession, path, renames: dict | None = None, keep=(), fill_missing: bool = False) -> DataFrame:
    """CSV scan of raw hourly reports, the four used columns as text (SRC-1, PRJ-1).

    ``path`` is a file, folder, glob or a list of them; columns are found by
    name in each file.  Every column is read as a string (a file may have
    many); only the renamed four (plus ``keep``) are selected, so the CSV
    reader parses only those columns.  A file without one of them is an error
    that names it, or has nulls there with ``fill_missing``.
    """
    renames = renames or RAW_RENAMES
    return _by_name(spark, path, {**{dst: [src] for src, dst in renames.items()}, **{c: [c] for c in keep}}, fill_missing)


def read_series(spark: SparkSession, path, fmt: str = "csv", strict: bool = True) -> DataFrame:
    """Clean-series scan (SRC-2..5): accept ``DATE`` or ``date``, check measures, parse the time.

    CSV columns are found by name in each file.  ``strict`` parses times with
    an ANSI cast (a bad value fails the job, PRJ-3).
    """
    if fmt == "csv":
        df = _by_name(spark, path, {"date": ["DATE", "date"], **{m: [m] for m in MEASURES}})
    else:
        df = spark.read.format(fmt).load(path)
        if "DATE" in df.columns:
            df = df.withColumnRenamed("DATE", "date")
        elif "date" not in df.columns:
            raise ValueError(f"{path}: no time column (DATE or date) among {df.columns}")
        missing = [c for c in MEASURES if c not in df.columns]
        if missing:
            raise ValueError(f"{path}: measures not found: {missing}")
    t = F.col("date").cast("string").cast("timestamp_ntz") if strict else F.col("date").cast("string").try_cast("timestamp_ntz")
    return df.select(t.alias("date"), *[F.col(m).cast("double").alias(m) for m in MEASURES])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, asked of the file system that Spark reads it from."""
    fs, p = storage.file_system(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


_BAD = "_unparsed_line"


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Strict JSONL scan (SRC-6): blank lines skipped, a malformed line fails the job with its file and text.

    :func:`bad_lines` gives the line numbers of all of them.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing at {path}")
    with_bad = StructType([*schema.fields, StructField(_BAD, StringType())])
    df = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)
    first = F.col(f"`{schema.fields[0].name}`")
    # the first column goes into the message as well: Spark does not read the unparsed line on its own
    message = F.concat(F.lit("malformed JSON line in "), F.col("_metadata.file_path"), F.lit(": "), F.substring(_BAD, 1, 200),
                       F.when(first.isNotNull(), F.lit(" (in part read)")).otherwise(F.lit("")))
    return df.where(F.when(F.col(_BAD).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop(_BAD)


def bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, line, text) of every malformed JSONL line; lines count from 1.

    Files are split among tasks: a line's place in its split is numbered as it
    is read, and the line counts of the splits before it in its file are added.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing at {path}")
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("block"), at.alias("at"))
    split = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"))   # a row for each split
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parsed = F.from_json("value", StructType([*schema.fields, StructField(_BAD, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    bad = lines.where((F.trim("value") != "") & parsed[_BAD].isNotNull())
    return (bad.join(split.withColumn("before", before), ["file", "block"])
            .select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.col("value").alias("text")))


def check_jsonl(spark: SparkSession, path: str, schema: StructType, most: int = 5) -> None:
    """Raise one error that names the first malformed lines by file and number, if there are any (a pass over the files)."""
    found = bad_lines(spark, path, schema).orderBy("file", "line").limit(most).collect()
    if found:
        raise ValueError("malformed JSON: " + "; ".join(f"{r.file}:{r.line}: {r.text[:200]}" for r in found))


def read_records(spark: SparkSession, paths: dict, schema: StructType = RESPONSE_SCHEMA) -> DataFrame:
    """Multi-file JSONL scan tagged with the source system; absent files are skipped (SRC-7, SET-1)."""
    import warnings

    frames = []
    for system, path in paths.items():
        if not path_exists(spark, path):
            warnings.warn(f"missing file for {system}: {path}")
            continue
        frames.append(read_jsonl(spark, path, schema).withColumn("source_system", F.lit(system)))
    if not frames:
        return spark.createDataFrame([], StructType(list(schema.fields) + [StructField("source_system", StringType())]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_scores_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Scores CSV scan (SRC-8): multi-line quoted text, empty text read as null."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


# FIXED VALUES: column order of the single-tool score CSV.
SINGLE_SCORE_COLUMNS = [
    "request_time", "forecast_target_time_expected", "forecast_target_time_observed", "target_time_match",
    "expected_temperature", "observed_temperature", "temperature_match",
    "expected_dew_point", "observed_dew_point", "dew_point_match",
    "expected_wind_speed", "observed_wind_speed", "wind_speed_match",
    "missing_fields", "mismatch_fields", "extra_terms",
    "value_hallucinated", "policy_violation", "response_issue", "llm_response",
]


def _text_lists(df: DataFrame, python_bools: bool) -> DataFrame:
    cols = {f.name: F.array_join(F.col(f.name), ";") for f in df.schema.fields if isinstance(f.dataType, ArrayType)}
    if python_bools:
        cols.update({f.name: F.when(F.col(f.name), F.lit("True")).when(~F.col(f.name), F.lit("False"))
                     for f in df.schema.fields if isinstance(f.dataType, BooleanType)})
    return df.withColumns(cols)


def _csv_field(c) -> "F.Column":
    """One field with minimal quoting: quoted when it holds a comma, quote, CR or LF."""
    s = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(s.rlike('[,"\r\n]'), quoted).otherwise(s), F.lit(""))


def write_csv(df: DataFrame, path: str, columns=None, mode: str = "overwrite", skip_empty: bool = False,
              python_bools: bool = False, line_sep: str = "\n") -> bool:
    """CSV sink with header (SNK-1..3): list columns joined by ';', optional fixed column order.

    ``skip_empty`` writes nothing for an empty result (one limit-1 probe job);
    ``python_bools`` renders booleans as ``True`` / ``False``.  ``line_sep``
    other than ``\n`` (e.g. ``\r\n``, as Python's csv module writes) renders
    the lines as text into one file -- meant for summary-sized results.
    Returns whether anything was written.
    """
    out = _text_lists(df, python_bools)
    if columns:
        out = out.select(*columns)
    if skip_empty and out.isEmpty():
        return False
    if line_sep == "\n":
        (out.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
            .option("emptyValue", "").option("maxRecordsPerFile", ROWS_PER_FILE).csv(path))
        return True
    spark = out.sparkSession
    header = spark.createDataFrame([(0, 0, ",".join(out.columns))], "_o int, _r long, value string")
    # keep the input row order (partition index is in the id's high bits) through the single-file shuffle
    body = out.select(F.lit(1).alias("_o"), F.monotonically_increasing_id().alias("_r"),
                      F.concat_ws(",", *[_csv_field(F.col(f"`{c}`")) for c in out.columns]).alias("value"))
    lines = header.unionByName(body).repartition(1).sortWithinPartitions("_o", "_r").select("value")
    lines.write.mode(mode).option("lineSep", line_sep).text(path)
    return True


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", python_compatible: bool = False,
                columns=None, gzip: bool = False) -> None:
    """JSONL sink keeping null fields (SNK-4 overwrite, SNK-5 append); ``gzip`` for logs that grow.

    ``python_compatible`` writes each row exactly as Python's ``json.dumps``
    would (``", "`` / ``": "`` separators, non-ASCII as ``\\uXXXX``); flat
    records of strings, numbers, booleans and string lists.
    """
    options = GZIP if gzip else {}
    if not python_compatible:
        df.write.mode(mode).option("ignoreNullFields", "false").options(**options).json(path)
        return
    from ..functions.answers import python_json_line

    df.select(python_json_line(df, columns).alias("value")).write.mode(mode).options(**options).text(path)


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink (the engine's internal format); partition by e.g. month for time pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_summary_json(summary: DataFrame, path: str, key: str | None = "system", pretty: bool = False) -> None:
    """One JSON document ``{key: {metric: value}}`` (SNK-6) as a single text file.

    ``key=None`` writes a one-row summary as a flat object; ``pretty`` uses
    the ``json.dump(obj, indent=2)`` layout.
    """
    from ..operators.summary import summary_document

    summary_document(summary, key, pretty).coalesce(1).write.mode("overwrite").text(path)
