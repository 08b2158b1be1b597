"""Record resolvers: turn heterogeneous response / case records into one shape.

Records come from different systems and file versions, so a field may be
nested, flat, or absent.  "Present" in a JSON record becomes "not null" here;
a column absent from the schema resolves to null.  All resolvers are column
expressions (PRJ-10..14) and the union is ``unionByName`` (SET-1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocab

MEASURES = vocab.MEASURES


def has_path(df: DataFrame, path: str) -> bool:
    """True when the dotted path exists in the schema."""
    dtype = df.schema
    for part in path.split("."):
        if not isinstance(dtype, StructType) or part not in dtype.fieldNames():
            return False
        dtype = dtype[part].dataType
    return True


def field(df: DataFrame, path: str, cast: str | None = None) -> Column:
    """Column for a dotted path, or a typed null when the path is absent."""
    c = F.col(path) if has_path(df, path) else F.lit(None)
    return c.cast(cast) if cast else c


def prediction_of(df: DataFrame) -> Column:
    """Nested ``prediction`` else flat ``predicted_*`` (PRJ-10), as a struct of doubles."""
    return F.struct(*[
        F.coalesce(field(df, f"prediction.{m}", "double"), field(df, f"predicted_{m}", "double")).alias(m)
        for m in MEASURES
    ])


def actual_of(df: DataFrame) -> Column:
    """Nested ``actual`` else flat ``actual_*`` (PRJ-10)."""
    return F.struct(*[
        F.coalesce(field(df, f"actual.{m}", "double"), field(df, f"actual_{m}", "double")).alias(m)
        for m in MEASURES
    ])


def expected_of(df: DataFrame) -> Column:
    """Expected forecast, precedence tool_output > prediction > expected_prediction > flat (PRJ-11).

    The precedence is decided per record on the *struct* (present = not null),
    so values are never mixed across sources.
    """
    top_time = field(df, "forecast_target_time", "string")

    def from_tool():
        return F.struct(
            field(df, "tool_output.forecast_target_time", "string").alias("forecast_target_time"),
            *[field(df, f"tool_output.predicted_{m}", "double").alias(m) for m in MEASURES],
        )

    def from_nested(name):
        return F.struct(top_time.alias("forecast_target_time"),
                        *[field(df, f"{name}.{m}", "double").alias(m) for m in MEASURES])

    flat = F.struct(top_time.alias("forecast_target_time"),
                    *[field(df, f"predicted_{m}", "double").alias(m) for m in MEASURES])
    none_given = reduce(lambda a, b: a & b, [field(df, f"predicted_{m}", "double").isNull() for m in MEASURES])
    out = F.when(none_given, F.raise_error(F.lit("a record states no expected forecast"))).otherwise(flat)
    for name, build in (("expected_prediction", lambda: from_nested("expected_prediction")),
                        ("prediction", lambda: from_nested("prediction")),
                        ("tool_output", from_tool)):
        if has_path(df, name):
            out = F.when(F.col(name).isNotNull(), build()).otherwise(out)
    return out


def response_text(df: DataFrame, profile: str = "v2") -> Column:
    """``final_response`` if present, else ``llm_response``, else ''; profile v1 reads ``llm_response`` alone (PRJ-13)."""
    if profile == "v1":
        return F.coalesce(field(df, "llm_response", "string"), F.lit(""))
    return F.coalesce(field(df, "final_response", "string"), field(df, "llm_response", "string"), F.lit(""))


def system_name(df: DataFrame, fallback: Column | str | None = None) -> Column:
    """``system`` > ``system_type`` containing agentic / single > source tag (PRJ-14)."""
    st = field(df, "system_type", "string")
    fb = F.lit(fallback) if isinstance(fallback, str) or fallback is None else fallback
    if fallback is None and has_path(df, "source_system"):
        fb = F.col("source_system")
    return F.coalesce(
        field(df, "system", "string"),
        F.when(F.contains(st, F.lit("agentic")), F.lit("agentic")).when(F.contains(st, F.lit("single")), F.lit("single_tool")),
        fb.cast("string"),
    )


def normalise(df: DataFrame, fallback_system: str | None = None, profile: str = "v2") -> DataFrame:
    """One narrow projection to the record shape the scoring profiles read.

    ``profile='v1'`` reads the expectation from ``expected_prediction`` first
    (the v1 record form) and the time from the top level.
    """
    exp = expected_of(df)
    if profile == "v1" and has_path(df, "expected_prediction"):
        exp = F.when(
            F.col("expected_prediction").isNotNull(),
            F.struct(field(df, "forecast_target_time", "string").alias("forecast_target_time"),
                     *[field(df, f"expected_prediction.{m}", "double").alias(m) for m in MEASURES]),
        ).otherwise(exp)
    time_src = field(df, "forecast_target_time", "string") if profile == "v1" else exp.getField("forecast_target_time")
    out = df.select(
        field(df, "case_id", "bigint").alias("case_id"),
        system_name(df, fallback_system).alias("system"),
        field(df, "request_time", "string").alias("request_time"),
        time_src.alias("expected_time"),
        exp.alias("_exp"),
        response_text(df, profile).alias("response"),
    )
    return out.select(
        "case_id", "system", "request_time", "expected_time",
        *[F.col(f"_exp.{m}").alias(f"expected_{m}") for m in MEASURES],
        "response",
    )


def union_records(frames: dict) -> DataFrame:
    """Union the systems' records with differing fields (SET-1, SRC-7).

    ``frames`` maps a source tag to a DataFrame; each row gets ``source_system``
    and missing columns become null.
    """
    tagged = [df.withColumn("source_system", F.lit(tag)) for tag, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
