"""Per-system and whole-table score summaries (AGG-4..8, SNK-6 shape).

One hash aggregate each, partial per task then final per system: the score
rows themselves never meet in one place.  Rates are count / total in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

MEASURES = vocab.MEASURES
_MATCHES = ["target_time_match"] + [f"{m}_match" for m in MEASURES]


def _rate(cnt, total):
    return F.when(total > 0, cnt.cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def _summary(scores: DataFrame, flags, by=("system",), extra_counts=()) -> DataFrame:
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("total_cases")]
    aggs += [F.count_if(F.col(f)).alias(f"_{f}") for f in flags + _MATCHES]
    aggs += [F.count_if(cond).alias(name) for name, cond in extra_counts]
    g = scores.groupBy(*by).agg(*aggs)
    total = F.col("total_cases")
    return g, total


def summarize_v2(scores: DataFrame, by=("system",)) -> DataFrame:
    """Per system: 3 issue counts and rates, 4 match rates (AGG-4), sorted by system."""
    flags = ["value_hallucinated", "policy_violation", "response_issue"]
    g, total = _summary(scores, flags, by)
    names = {"value_hallucinated": ("value_hallucinated_cases", "value_hallucination_rate"),
             "policy_violation": ("policy_violation_cases", "policy_violation_rate"),
             "response_issue": ("response_issue_cases", "response_issue_rate")}
    cols = [*by, F.col("total_cases").cast("bigint").alias("total_cases")]
    for f in flags:
        c, r = names[f]
        cols += [F.col(f"_{f}").cast("bigint").alias(c), _rate(F.col(f"_{f}"), total).alias(r)]
    cols += [_rate(F.col(f"_{m}"), total).alias(f"{m}_rate") for m in _MATCHES]
    return g.select(*cols).orderBy(*by)


def summarize_v1(scores: DataFrame, by=("system",)) -> DataFrame:
    """Per system: hallucinated count / rate, 4 match rates, unsupported-claim cases (AGG-5).

    ``unsupported_terms`` may be ';' text or an array; non-empty counts.
    """
    ut = scores.schema["unsupported_terms"].dataType.simpleString()
    nonempty = (F.size("unsupported_terms") > 0) if ut.startswith("array") else (F.length("unsupported_terms") > 0)
    g, total = _summary(scores, ["hallucinated"], by, extra_counts=[("_unsupported", nonempty)])
    return g.select(
        *by, F.col("total_cases").cast("bigint").alias("total_cases"),
        F.col("_hallucinated").cast("bigint").alias("hallucinated_cases"),
        _rate(F.col("_hallucinated"), total).alias("hallucination_rate"),
        *[_rate(F.col(f"_{m}"), total).alias(f"{m}_rate") for m in _MATCHES],
        F.col("_unsupported").cast("bigint").alias("unsupported_claim_cases"),
    ).orderBy(*by)


def summarize_table(scores: DataFrame) -> DataFrame:
    """Whole-table report of the single-tool profile (AGG-6): one row."""
    return summarize_v2(scores.withColumn("_all", F.lit("all")), by=("_all",)).drop("_all").withColumnRenamed(
        "total_cases", "records_scored")


def flag_counts(scores: DataFrame, by=("system", "hallucinated")) -> DataFrame:
    """Group sizes over two keys (AGG-7)."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def named_summary(scores: DataFrame, flag: str = "hallucinated", by=("system",)) -> DataFrame:
    """Named multi-aggregate (AGG-8): count of ids, sum of the flag, 4 means, derived rate."""
    by = list(by)
    g = scores.groupBy(*by).agg(
        F.count("case_id").cast("bigint").alias("total_cases"),
        F.sum(F.col(flag).cast("int")).cast("bigint").alias(f"{flag}_cases"),
        *[F.avg(F.col(m).cast("double")).alias(f"{m}_rate") for m in _MATCHES],
    )
    return g.withColumn(
        "hallucination_rate" if flag == "hallucinated" else f"{flag}_rate",
        F.col(f"{flag}_cases").cast("double") / F.col("total_cases").cast("double"),
    )


def summary_document(summary: DataFrame, key: str | None = "system", pretty: bool = False) -> DataFrame:
    """One-row JSON document ``{system: {metric: value}}`` (SNK-6), built by aggregation.

    ``key=None`` renders a one-row summary as a flat object.  ``pretty`` lays
    it out as ``json.dump(obj, indent=2)`` does (keys sorted by system).
    """
    from ..functions.answers import python_json_pretty, python_json_string

    if key is None:
        dtype = summary.schema
        row = F.struct(*summary.columns)
        text = python_json_pretty(row, dtype) if pretty else F.to_json(row)
        return summary.select(text.alias("json"))
    metrics = [c for c in summary.columns if c != key]
    mtype = summary.select(F.struct(*metrics).alias("m")).schema["m"].dataType
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*metrics).alias("value"))))
    if not pretty:
        return summary.agg(F.to_json(F.map_from_entries(entries)).alias("json"))
    body = F.array_join(F.transform(entries, lambda e: F.concat(
        F.lit("  "), python_json_string(e["key"]), F.lit(": "), python_json_pretty(e["value"], mtype, 2, 1))), ",\n")
    return summary.agg(F.when(F.size(entries) == 0, F.lit("{}"))
                       .otherwise(F.concat(F.lit("{\n"), body, F.lit("\n}"))).alias("json"))
