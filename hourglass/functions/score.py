"""Text-against-structure scoring, three profiles (FN-12..21).

Input is a *normalised record* frame (see ``operators.records.normalise``)
with the columns ``case_id, system, request_time, expected_time,
expected_temperature, expected_dew_point, expected_wind_speed, response``.

The regex work runs in one projection (each regex once per row, see text.let);
the score row is then expanded through a one-row generator (``barrier_row``)
so a filter on a derived flag (say ``response_issue``) stays above it and
never copies the extraction into the filter.  No shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import vocab

MEASURES = vocab.MEASURES


def _lists(df: DataFrame, cols, as_text: bool) -> DataFrame:
    """Lists are built as ';' text; turn them into arrays unless text is wanted."""
    if as_text:
        return df
    return df.withColumns({c: T.text_list_to_array(F.col(c)) for c in cols})


def _inputs(records: DataFrame, round_expected: bool, terms, normalise_terms: bool) -> DataFrame:
    """One projection: expectations, the extraction struct and the found-terms text."""
    exp = (lambda c: F.round(F.col(c).cast("double"), 2)) if round_expected else (lambda c: F.col(c).cast("double"))
    return records.select(
        "case_id", "system", "request_time", "response", F.col("expected_time").alias("te"),
        *[exp(f"expected_{m}").alias(f"e_{m}") for m in MEASURES],
        T.extract_forecast_fields(F.col("response")).alias("x"),
        T.found_terms_text(F.col("response"), terms, normalise_terms).alias("terms"),
    )


def _value_row(s, terms_name: str) -> Column:
    """Score fields from the extracted columns (same rule for v2 and single)."""
    x = s("x")
    match = {"forecast_target_time": x["forecast_target_time"].eqNullSafe(s("te"))}
    for m in MEASURES:
        match[f"predicted_{m}"] = T.numeric_match(s(f"e_{m}"), x[f"predicted_{m}"])
    missing = T.present_list(*[(x[f].isNull(), f) for f in vocab.FORECAST_FIELDS])
    mismatch = T.present_list(*[(x[f].isNotNull() & ~match[f], f) for f in vocab.FORECAST_FIELDS])
    value = (missing != F.lit("")) | (mismatch != F.lit(""))
    policy = s("terms") != F.lit("")
    fields = [
        s("te").alias("forecast_target_time_expected"),
        x["forecast_target_time"].alias("forecast_target_time_observed"),
        match["forecast_target_time"].alias("target_time_match"),
    ]
    for m in MEASURES:
        fields += [s(f"e_{m}").alias(f"expected_{m}"), x[f"predicted_{m}"].alias(f"observed_{m}"),
                   match[f"predicted_{m}"].alias(f"{m}_match")]
    fields += [missing.alias("missing_fields"), mismatch.alias("mismatch_fields"), s("terms").alias(terms_name),
               value.alias("value_hallucinated"), policy.alias("policy_violation"),
               (value | policy).alias("response_issue"), s("response").alias("llm_response")]
    return F.struct(*fields)


def _profile(records: DataFrame, round_expected: bool, terms, normalise_terms: bool, terms_name: str) -> DataFrame:
    x = _inputs(records, round_expected, terms, normalise_terms)
    return T.barrier_row(x, ["case_id", "system", "request_time"], _value_row(F.col, terms_name))


def score_v2(records: DataFrame, lists_as_text: bool = True) -> DataFrame:
    """Profile ``v2``: expectations rounded to 2, 29 terms on lower-cased text."""
    out = _profile(records, True, vocab.TERMS_V2, False, "unsupported_terms")
    return _lists(out, ["missing_fields", "mismatch_fields", "unsupported_terms"], lists_as_text)


def score_single(records: DataFrame, lists_as_text: bool = False) -> DataFrame:
    """Profile ``single``: unrounded expectations, 24 terms on normalised text.

    Lists stay arrays (the JSONL form) unless ``lists_as_text``.
    """
    out = _profile(records, False, vocab.TERMS_SINGLE, True, "extra_terms")
    return _lists(out, ["missing_fields", "mismatch_fields", "extra_terms"], lists_as_text)


def _v1_row(s) -> Column:
    nums = s("nums")
    match = {"forecast_target_time": F.coalesce(F.contains(s("response"), s("te")), F.lit(False))}
    for m in MEASURES:
        match[m] = T.number_present(nums, s(f"e_{m}"))
    failed = T.present_list(*[(~match[k], k) for k in ("forecast_target_time", *MEASURES)])
    hall = failed != F.lit("")
    fields = [s("te").alias("forecast_target_time_expected"), match["forecast_target_time"].alias("target_time_match")]
    for m in MEASURES:
        fields += [s(f"e_{m}").alias(f"expected_{m}"), match[m].alias(f"{m}_match")]
    fields += [failed.alias("missing_fields"), failed.alias("mismatch_fields"), s("terms").alias("unsupported_terms"),
               (hall | (s("terms") != F.lit(""))).alias("hallucinated"), s("response").alias("llm_response")]
    return F.struct(*fields)


def score_v1(records: DataFrame, lists_as_text: bool = True) -> DataFrame:
    """Profile ``v1``: time by substring, values as any number within 0.01, one flag.

    Kept as the original defines it: the same names land in both lists, and any
    number in the text counts, date digits included.
    """
    x = records.select(
        "case_id", "system", "request_time", "response", F.col("expected_time").alias("te"),
        *[F.round(F.col(f"expected_{m}").cast("double"), 2).alias(f"e_{m}") for m in MEASURES],
        F.transform(T.all_numbers(F.col("response")), lambda n: F.round(n, 2)).alias("nums"),
        T.found_terms_text(F.col("response"), vocab.TERMS_V1, False).alias("terms"),
    )
    out = T.barrier_row(x, ["case_id", "system", "request_time"], _v1_row(F.col))
    return _lists(out, ["missing_fields", "mismatch_fields", "unsupported_terms"], lists_as_text)


PROFILES = {"v1": score_v1, "v2": score_v2, "single": score_single}


def score(records: DataFrame, profile: str = "v2", **kw) -> DataFrame:
    """Score with a named profile."""
    return PROFILES[profile](records, **kw)
