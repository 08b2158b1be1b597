"""Answer production per case: restricted tool view, verification, verified
template, prompts, and a pluggable batch text generator (PRJ-8/9, FN-22..28, UDF-1..4).

Everything except the generator is column expressions.  The generator is the
only Python on the data path: an iterator pandas UDF over the prompt column
alone, so a model is loaded once per task, is called on many prompts at a
time, and never sees actual values or errors.
"""

from __future__ import annotations

from typing import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.answers import pretty_json, python_list_text, render_template
from ..functions.text import fmt_num

MEASURES = vocab.MEASURES

TOOL_FIELDS = [("request_time", True), ("forecast_target_time", True),
               ("predicted_temperature", False), ("predicted_dew_point", False), ("predicted_wind_speed", False)]

# FIXED VALUES: prompt texts given to the text generator.
ANSWER_PROMPT = """You are a weather forecasting assistant.

The weather forecast tool has already been called once. Use ONLY the tool output below to answer the user.

Tool output:
{tool_json}

User request:
Give me the weather forecast for 24 hours after {request_time}.

Rules:
- Do not invent extra weather details.
- Do not report actual observed values.
- Do not report absolute error values.
- Preserve the forecast target time exactly.
- Preserve the predicted temperature, dew point, and wind speed exactly.
- Your answer should include only the forecast target time, predicted temperature, predicted dew point, and predicted wind speed.

Write a concise final answer.
"""

PLANNING_PROMPT_V2 = """You are part of an agentic weather forecasting system.

The user asks:
Give me the weather forecast for 24 hours after {request_time}.

The weather forecast tool has already returned this structured output:
{tool_json}

Your job is only to make a short plan before the final answer is produced.

Return a short plan with these steps:
1. Identify the request time.
2. Use the forecast tool output.
3. Verify the forecast target time, predicted temperature, predicted dew point, and predicted wind speed.
4. Produce a final answer using only verified values.

Do not produce the final weather forecast in this planning step.
"""

PLANNING_PROMPT_V1 = """You are part of an agentic weather forecasting system.

The user asks:
Give me the weather forecast for 24 hours after {request_time}.

Your job is only to identify what information is needed before answering.

Return a short plan with these steps:
1. Identify the request time.
2. Use the forecast tool output.
3. Verify the required forecast fields.
4. Produce a final answer using only verified values.
"""


# FIXED VALUES: the two prototype prompts (a local model's single prompt, a chat model's system and user prompt).
PROTOTYPE_PROMPT = """You are a simple weather forecasting assistant.

You are given a user request and the output of a forecasting tool.

Rules:
- Use only the tool output.
- Do not invent weather values.
- Do not add explanations about storms, fronts, pressure, clouds, or causes.
- Report only the forecast target time, predicted temperature, predicted dew point, and predicted wind speed.
- Keep the answer short.

User request:
{user_request}

Tool output:
{tool_json}

Final answer:"""

CHAT_SYSTEM_PROMPT = """You are a simple weather forecasting assistant.

You are given the user's request and the output of a weather forecasting tool.

Rules:
1. Use only the tool output.
2. Do not invent weather values.
3. Do not mention causes, storms, fronts, pressure systems, or outside weather details unless they appear in the tool output.
4. Report the predicted temperature, dew point, and wind speed.
5. Mention the forecast target time.
6. Keep the response short."""

CHAT_USER_PROMPT = """User request:
{user_request}

Tool output:
{tool_json}

Write the final forecast response."""


def tool_view(prediction: str = "prediction") -> Column:
    """Restricted view: the five forecast fields, no actuals or errors (PRJ-8)."""
    return F.struct(
        F.col("request_time"), F.col("forecast_target_time"),
        *[F.col(f"{prediction}.{m}").alias(f"predicted_{m}") for m in MEASURES],
    )


def user_request(request_time: Column) -> Column:
    """User-request sentence (FN-28)."""
    return render_template(vocab.USER_REQUEST, request_time=request_time)


def verify_v2(tool: Column) -> Column:
    """Required-field check, absent or null is missing (FN-22)."""
    missing = F.filter(
        F.array(*[F.when(tool[f].isNull(), F.lit(f)) for f in vocab.REQUIRED_TOOL_FIELDS]),
        lambda x: x.isNotNull(),
    )
    return F.struct(
        (F.size(missing) == 0).alias("verified"),
        missing.alias("missing_fields"),
        *[tool[f].alias(f) for f in vocab.REQUIRED_TOOL_FIELDS],
    )


def answer_v2(verification: Column) -> Column:
    """Verified 4-sentence answer, or the refusal naming missing fields (FN-24)."""
    v = verification
    ok = render_template(vocab.VERIFIED_V2, t=v["forecast_target_time"],
                         x=fmt_num(v["predicted_temperature"]),
                         y=fmt_num(v["predicted_dew_point"]),
                         z=fmt_num(v["predicted_wind_speed"]))
    no = render_template(vocab.REFUSAL_V2, missing=F.array_join(v["missing_fields"], ", "))
    return F.when(v["verified"], ok).otherwise(no)


def verify_v1(df: DataFrame) -> Column:
    """v1 check on the case itself; nested names ``prediction.x``; children only when prediction exists (FN-23)."""
    pred_present = F.col("prediction").isNotNull()
    checks = [F.when(F.col(f).isNull(), F.lit(f)) for f in ("request_time", "forecast_target_time", "prediction")]
    checks += [F.when(pred_present & F.col(f"prediction.{m}").isNull(), F.lit(f"prediction.{m}")) for m in MEASURES]
    missing = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return F.struct(
        (F.size(missing) == 0).alias("verified"),
        missing.alias("missing_fields"),
        F.col("request_time"), F.col("forecast_target_time"),
        *[F.col(f"prediction.{m}").alias(m) for m in MEASURES],
    )


def answer_v1(verification: Column) -> Column:
    """One-sentence answer, or refusal with the list rendered as Python prints it (FN-25)."""
    v = verification
    ok = render_template(vocab.VERIFIED_V1, t=v["forecast_target_time"],
                         x=fmt_num(v["temperature"]), y=fmt_num(v["dew_point"]),
                         z=fmt_num(v["wind_speed"]))
    no = render_template(vocab.REFUSAL_V1, missing=python_list_text(v["missing_fields"]))
    return F.when(v["verified"], ok).otherwise(no)


def answer_prompt(df: DataFrame, tool_col: str = "tool_output") -> Column:
    """Single-tool answer prompt (FN-26, FN-27)."""
    return render_template(ANSWER_PROMPT, tool_json=pretty_json(F.col(tool_col), TOOL_FIELDS),
                           request_time=F.col("request_time"))


def planning_prompt(df: DataFrame, version: str = "v2", tool_col: str = "tool_output") -> Column:
    if version == "v1":
        return render_template(PLANNING_PROMPT_V1, request_time=F.col("request_time"))
    return render_template(PLANNING_PROMPT_V2, tool_json=pretty_json(F.col(tool_col), TOOL_FIELDS),
                           request_time=F.col("request_time"))


def prototype_prompt(tool_col: str = "tool_output") -> Column:
    """The local prototype's prompt, without blanks around it (FN-26)."""
    return render_template(PROTOTYPE_PROMPT, user_request=user_request(F.col("request_time")),
                           tool_json=pretty_json(F.col(tool_col), TOOL_FIELDS))


def chat_prompts(tool_col: str = "tool_output") -> Column:
    """System and user message of the chat prototype (FN-26)."""
    return F.struct(F.lit(CHAT_SYSTEM_PROMPT).alias("system"), render_template(
        CHAT_USER_PROMPT, user_request=user_request(F.col("request_time")),
        tool_json=pretty_json(F.col(tool_col), TOOL_FIELDS)).alias("user"))


def verified_run(cases: DataFrame, run_timestamp: str | None = None,
                 plan_generator_factory: Callable[[], "Generator"] | None = None,
                 model_path: str | None = None, parallelism: int | None = None) -> DataFrame:
    """Verified system (UDF-3): tool view -> verify -> template.

    ``cases`` needs ``case_id, request_time, forecast_target_time, prediction``
    (``actual`` / ``absolute_error`` are carried when present).  With a
    ``plan_generator_factory`` the planning prompt is sent through
    :func:`generate` and stored as ``agent_plan``; the plan never changes the
    answer, which is built from the verified fields only.
    """
    c = cases if "tool_output" in cases.columns else cases.withColumn("tool_output", tool_view())
    if plan_generator_factory is not None:
        c = c.withColumn("_plan_prompt", planning_prompt(c, "v2"))
        c = generate(c, "_plan_prompt", plan_generator_factory, out_col="agent_plan", parallelism=parallelism)
        c = c.drop("_plan_prompt")
    else:
        c = c.withColumn("agent_plan", F.lit(None).cast("string"))
    c = c.withColumn("verification", verify_v2(F.col("tool_output")))
    keep = [x for x in ("actual", "absolute_error") if x in c.columns]
    out = c.select(
        *([F.lit(run_timestamp).alias("run_timestamp")] if run_timestamp else []),
        F.lit("agentic").alias("system"),
        F.lit("agentic_verification_pipeline").alias("system_type"),
        *([F.lit(model_path).alias("model_path")] if model_path else []),
        "case_id", "request_time", "forecast_target_time", "tool_output", "prediction", *keep,
        user_request(F.col("request_time")).alias("user_request"),
        "agent_plan",
        "verification",
        answer_v2(F.col("verification")).alias("final_response"),
    )
    return out.withColumn("llm_response", F.col("final_response"))


def verified_run_v1(cases: DataFrame) -> DataFrame:
    """v1 verified system: record with ``expected_prediction`` and the one-sentence answer."""
    v = cases.withColumn("verification", verify_v1(cases))
    return v.select(
        "case_id", F.lit("agentic").alias("system"), "request_time", "forecast_target_time",
        F.col("prediction").alias("expected_prediction"),
        F.lit(None).cast("string").alias("agent_plan"), "verification",
        answer_v1(F.col("verification")).alias("llm_response"),
    )


Generator = Callable[[pd.Series], Iterable[str]]


def generate(df: DataFrame, prompt_col: str, generator_factory: Callable[[], Generator],
             out_col: str = "llm_response", parallelism: int | None = None) -> DataFrame:
    """Pluggable batch text generation (UDF-1).

    ``generator_factory`` is called once per task (load the model there); the
    returned callable maps a batch of prompts to one text each.  Only the
    prompt column goes to Python; the other columns stay in the JVM.  Marked
    nondeterministic, so that no plan calls it twice for a row.
    ``parallelism`` caps concurrent model copies via ``repartition``.
    """
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gen = generator_factory()
        for batch in prompts:
            yield pd.Series(list(gen(batch)), index=batch.index, dtype=object)

    call = F.pandas_udf(run, "string").asNondeterministic()
    src = df.repartition(parallelism) if parallelism else df
    return src.withColumn(out_col, call(F.col(prompt_col).cast("string")))


def single_tool_run(cases: DataFrame, generator_factory: Callable[[], Generator], run_timestamp: str | None = None,
                    parallelism: int | None = None, model_path: str | None = None) -> DataFrame:
    """Single-tool system (UDF-2): tool view + prompt -> generator -> response record."""
    c = cases if "tool_output" in cases.columns else cases.withColumn("tool_output", tool_view())
    c = c.withColumn("prompt", answer_prompt(c))
    g = generate(c, "prompt", generator_factory, parallelism=parallelism)
    keep = [x for x in ("actual", "absolute_error") if x in c.columns]
    return g.select(
        *([F.lit(run_timestamp).alias("run_timestamp")] if run_timestamp else []),
        F.lit("single_tool").alias("system"),
        F.lit("single_tool_local_model").alias("system_type"),
        *([F.lit(model_path).alias("model_path")] if model_path else []),
        "case_id", "request_time", "forecast_target_time", "tool_output", "prediction", *keep,
        user_request(F.col("request_time")).alias("user_request"),
        "llm_response",
    )
