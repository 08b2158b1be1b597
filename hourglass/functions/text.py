"""Column expressions for reading forecast values back out of free text.

All of it is built-in Spark SQL (regexp_*, filter, transform), with no Python
worker.  Java regex differs from Python's in three ways that matter here:
``.`` also stops at ``\\r`` (the ``(?d)`` flag, UNIX_LINES, makes it stop only at
``\\n``), and ``\\s`` and ``\\d`` are ASCII only.  Blanks are therefore written as
a Unicode class, times use ``\\p{Nd}``, and numbers are read from the text with
other scripts' digits turned into ASCII ones (one character each, so positions
stay).
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Characters from the first decimal digit beyond ASCII (Arabic-Indic zero) on.
_LATER_SCRIPTS = r"[\x{660}-\x{10FFFF}]"


def normalize_text(text) -> Column:
    """lower case, '_' -> ' ' (FN-6)."""
    return F.replace(F.lower(_c(text)), F.lit("_"), F.lit(" "))


def _later(t: Column, later: Column | None) -> Column:
    return t.rlike(_LATER_SCRIPTS) if later is None else later


def extract_datetime(text, later: Column | None = None) -> Column:
    """First ``yyyy-mm-dd<ws>hh:mm:ss`` in the raw text, null when absent (FN-7).

    ``later``: whether the text may hold digits of later scripts, if that is known already.
    """
    t = _c(text)
    pattern = vocab.DATETIME_PATTERN.replace(r"\s", vocab.BLANK_CLASS)
    # the property class is slower, so only texts that may hold such digits are searched with it
    found = F.when(_later(t, later), F.regexp_extract(t, pattern.replace(r"\d", r"\p{Nd}"), 0)).otherwise(F.regexp_extract(t, pattern, 0))
    return let(found, lambda s: F.when(s != F.lit(""), s))


def ascii_digits(text, later: Column | None = None) -> Column:
    """Decimal digits of every script as 0-9; a text without such digits is passed on as it is."""
    t = _c(text)
    digits = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd")
    plain = "".join(str(unicodedata.decimal(c)) for c in digits)
    return F.when(_later(t, later), F.translate(t, digits, plain)).otherwise(t)


def _num(s: Column) -> Column:
    # regexp_extract gives '' on no match; try_cast('' as double) is null.  (nullif
    # would be rewritten to if(s = '', null, s) and evaluate the regex twice.)
    return s.try_cast("double")


def number_near_label(norm_text, labels) -> Column:
    """First label (in order) with a near hit, else a far hit (FN-8).

    ``norm_text`` must already be normalised, with ASCII digits.  Returns null when no label hits.
    """
    t = _c(norm_text)
    tries = []
    for label in labels:
        lab = re.escape(label.lower()).replace("\\ ", " ")
        near = vocab.NEAR_TEMPLATE.format(label=lab).replace(r"\s", vocab.BLANK_CLASS)
        far = "(?d)" + vocab.FAR_TEMPLATE.format(label=lab)
        tries.append(_num(F.regexp_extract(t, near, 1)))
        tries.append(_num(F.regexp_extract(t, far, 1)))
    return F.coalesce(*tries)


def all_numbers(text) -> Column:
    """Every integer or decimal in the text, as doubles (FN-9)."""
    return F.transform(
        number_texts(ascii_digits(text)),
        lambda s: s.try_cast("double"),
    )


def text_after(text, needle) -> Column:
    """Text after the first occurrence of ``needle``; whole text if needle is null or absent (FN-10)."""
    t, n = _c(text), _c(needle)
    pos = F.position(n, t)
    return F.when(n.isNotNull() & (pos > 0), F.substr(t, pos + F.length(n))).otherwise(t)


def let(value: Column, body) -> Column:
    """Bind ``value`` once per row and use it several times in ``body``.

    A one-element ``transform``: the element is evaluated once and the body
    sees it as a lambda variable.  Unlike stacked projections this keeps the
    expression linear in size when the optimizer substitutes aliases (e.g.
    when a filter on a derived flag is pushed below the projection).
    """
    return F.get(F.transform(F.array(value), body), 0)


def number_texts(text) -> Column:
    """Every integer or decimal of a text with ASCII digits, as strings (no per-element lambda)."""
    return F.regexp_extract_all(_c(text), F.lit(vocab.NUMBER_PATTERN), F.lit(0))


def _fallback(dt, temp, dew, wind, nums) -> Column:
    """``nums`` is the array of number *texts* after the datetime."""
    use_fb = (temp.isNull() | dew.isNull() | wind.isNull()) & (F.size(nums) >= 3)
    pick = lambda i: F.get(nums, i).try_cast("double")
    return F.struct(
        dt.alias("forecast_target_time"),
        F.when(temp.isNull() & use_fb, pick(0)).otherwise(temp).alias("predicted_temperature"),
        F.when(dew.isNull() & use_fb, pick(1)).otherwise(dew).alias("predicted_dew_point"),
        F.when(wind.isNull() & use_fb, pick(2)).otherwise(wind).alias("predicted_wind_speed"),
    )


def extract_forecast_fields(text) -> Column:
    """Four-field extraction with positional fallback (FN-11), as one struct.

    Labels are searched in the normalised text; the datetime and the fallback
    numbers use the raw text.  The fallback fills only the absent fields, with
    numbers[0], [1], [2] after the datetime, when at least 3 numbers follow it;
    they are searched only where a field is absent.  Every regular expression
    appears once in the expression tree.
    """
    t = _c(text)
    first = F.struct(t.alias("t"), t.rlike(_LATER_SCRIPTS).alias("later"))

    def stage1(s):
        return let(F.struct(s["t"].alias("t"), s["later"].alias("later"), normalize_text(ascii_digits(s["t"], s["later"])).alias("n"),
                            extract_datetime(s["t"], s["later"]).alias("dt")), stage2)

    def stage2(s):
        found = F.struct(
            s["t"].alias("t"), s["later"].alias("later"), s["dt"].alias("dt"),
            number_near_label(s["n"], vocab.LABELS["predicted_temperature"]).alias("a"),
            number_near_label(s["n"], vocab.LABELS["predicted_dew_point"]).alias("b"),
            number_near_label(s["n"], vocab.LABELS["predicted_wind_speed"]).alias("c"),
        )

        def stage3(v):
            absent = v["a"].isNull() | v["b"].isNull() | v["c"].isNull()
            nums = F.when(absent, number_texts(ascii_digits(text_after(v["t"], v["dt"]), v["later"])))
            return let(nums, lambda ns: _fallback(v["dt"], v["a"], v["b"], v["c"], F.coalesce(ns, F.array().cast("array<string>"))))

        return let(found, stage3)

    return let(first, stage1)


def with_extracted(df: DataFrame, text_col: str, out_col: str = "_x") -> DataFrame:
    """Add the FN-11 extraction struct as ``out_col`` (one projection, each regex once per row)."""
    return df.withColumn(out_col, extract_forecast_fields(F.col(text_col)))


def barrier_row(df: DataFrame, keep, row: Column) -> DataFrame:
    """Expand a computed struct into columns through a one-row generator.

    ``inline(array(row))`` yields exactly one row per input row.  The optimizer
    does not push filters on generated columns below a Generate, so a filter on
    a derived flag never copies the (regex-heavy) expressions underneath into
    the filter; the work stays in code-generated projections below.
    """
    return df.select(*keep, F.inline(F.array(row)))


def present_list(*conds_names) -> Column:
    """';'-joined names whose condition holds, in argument order ('' when none).

    ``concat_ws`` skips nulls, so this stays inside generated code (no lambda).
    """
    return F.concat_ws(";", *[F.when(cond, F.lit(name)) for cond, name in conds_names])


def text_list_to_array(s) -> Column:
    """';' text back to an array ('' -> empty array)."""
    s = _c(s)
    return F.when(s == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(s, ";"))


def _terms_text(t: Column, terms) -> Column:
    return present_list(*[(F.contains(t, F.lit(x)), x) for x in terms])


def found_terms_text(text, terms, normalise: bool) -> Column:
    """Found terms as ';' text, fully inside generated code: the lowered text is a
    common subexpression of the per-term ``contains`` calls, evaluated once."""
    t = normalize_text(text) if normalise else F.lower(_c(text))
    return _terms_text(t, terms)


def found_terms(text, terms, normalise: bool) -> Column:
    """Found terms as an array, in vocabulary order (FN-15..17)."""
    return text_list_to_array(found_terms_text(text, terms, normalise))


def numeric_match(expected, observed, tolerance: float = vocab.MATCH_TOLERANCE) -> Column:
    """|e - o| <= tol in DOUBLE; absent observed -> false (FN-12)."""
    e, o = _c(expected), _c(observed)
    return F.coalesce(F.abs(e.cast("double") - o.cast("double")) <= F.lit(float(tolerance)), F.lit(False))


def number_present(numbers, expected, tolerance: float = vocab.PRESENCE_TOLERANCE) -> Column:
    """Any number within tolerance of the expected value (FN-13)."""
    e = _c(expected)
    return F.coalesce(F.exists(_c(numbers), lambda n: F.abs(n - e) <= F.lit(float(tolerance))), F.lit(False))


def fmt_num(x) -> Column:
    """Double to decimal text as Python's str() lays it out: positional from 1e-4 up to 1e16, else ``1e-05`` / ``1e+16``."""
    d = _c(x).cast("double")
    plain = d.cast("string")
    # the usual numbers take the first branch; the others are laid out in a lambda, which keeps the generated code small
    size = F.abs(d)
    return F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0.0), plain).otherwise(
        let(F.struct(d.alias("d"), plain.alias("s")), lambda v: _number_layout(v["d"], v["s"])))


def _number_layout(d: Column, s: Column) -> Column:
    """Python's layout of a double that the JVM writes with an exponent or as a word."""
    size = F.abs(d)
    power = F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    positional = F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0*$", "$1")
    scientific = F.concat(F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"\.0$", ""),
                          F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""),
                          F.abs(power).cast("string"))
    return (F.when(F.isnan(d), "nan").when(size == F.lit(float("inf")), F.when(d > 0, "inf").otherwise("-inf"))
            .when((size >= 1e-4) & (size < 1e16), positional).otherwise(scientific))


def fmt_ts(x) -> Column:
    """Timestamp to ``yyyy-MM-dd HH:mm:ss`` text (FN-30)."""
    return F.date_format(_c(x), "yyyy-MM-dd HH:mm:ss")
