"""Text rendering as column expressions: templates, pretty JSON, prompts (FN-24..28)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from .text import fmt_num

_SLOT = re.compile(r"\{(\w+)\}")


def render_template(template: str, **values) -> Column:
    """``concat`` of the template's literal parts and the given columns for ``{name}`` slots."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(F.lit(v) if isinstance(v, str) else v)
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def json_double(c: Column) -> Column:
    """A double as json.dumps writes it: like str(), but ``NaN`` and ``Infinity``."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), d.cast("string")).otherwise(fmt_num(d))


def json_value(c: Column, is_string: bool) -> Column:
    """One JSON value the way Python's json.dumps writes it (strings escaped, null, shortest floats)."""
    if is_string:
        esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        esc = F.replace(F.replace(esc, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
        body = F.concat(F.lit('"'), esc, F.lit('"'))
    else:
        body = json_double(c)
    return F.coalesce(body, F.lit("null"))


def pretty_json(struct_col: Column, fields) -> Column:
    """``json.dumps(obj, indent=2)`` of a flat struct (FN-27).

    Spark's ``to_json(pretty)`` writes ``"k" : v``; this writes ``"k": v``.
    ``fields`` is a list of (name, is_string).
    """
    if not fields:
        return F.lit("{}")
    items = []
    for i, (name, is_string) in enumerate(fields):
        sep = ",\n" if i < len(fields) - 1 else "\n"
        items += [F.lit(f'  "{name}": '), json_value(struct_col[name], is_string), F.lit(sep)]
    return F.concat(F.lit("{\n"), *items, F.lit("}"))


def struct_fields(dtype) -> list:
    """(name, is_string) pairs of a struct type, for :func:`pretty_json`."""
    return [(f.name, not isinstance(f.dataType, NumericType)) for f in dtype.fields]


def python_list_text(arr: Column) -> Column:
    """``['a', 'b']`` rendering of a string array (Python list repr)."""
    inner = F.array_join(F.transform(arr, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")
    return F.concat(F.lit("["), inner, F.lit("]"))


def _ascii_escaped(literal: Column) -> Column:
    """Escape every non-ASCII character of an ASCII-safe JSON literal as ``\\uXXXX``.

    The text is encoded as UTF-16BE, cut into 4-hex-digit code units (so
    astral characters become surrogate pairs, as Python writes them), and
    each unit at or above 0x80 becomes ``\\u`` + lower-case hex.  Only texts
    that contain non-ASCII characters take this per-character path.
    """
    units = F.regexp_extract_all(F.hex(F.encode(literal, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    chars = F.transform(units, lambda u: F.when(u < F.lit("0080"), F.decode(F.unhex(u), "UTF-16BE"))
                        .otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(literal.rlike("[^\\x00-\\x7F]"), F.array_join(chars, "")).otherwise(literal)


def python_json_string(c: Column) -> Column:
    """A string as ``json.dumps`` writes it (quotes, backslash and control escapes, ASCII only)."""
    lit = F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)   # Jackson-escaped "..."
    return F.when(c.isNull(), F.lit("null")).otherwise(_ascii_escaped(lit))


def python_json_value(c: Column, dtype) -> Column:
    """One value in ``json.dumps`` form: strings, numbers, booleans, arrays and structs (nested)."""
    from pyspark.sql.types import ArrayType, BooleanType, StructType

    if isinstance(dtype, StringType):
        return python_json_string(c)
    if isinstance(dtype, BooleanType):
        return F.when(c.isNull(), F.lit("null")).when(c, F.lit("true")).otherwise(F.lit("false"))
    if isinstance(dtype, ArrayType):
        inner = F.array_join(F.transform(c, lambda x: python_json_value(x, dtype.elementType)), ", ")
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    if isinstance(dtype, StructType):
        parts = []
        for i, f in enumerate(dtype.fields):
            parts += [F.lit(("" if i == 0 else ", ") + '"' + f.name + '": '), python_json_value(c[f.name], f.dataType)]
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), *parts, F.lit("}")))
    if isinstance(dtype, NumericType):
        return F.coalesce(json_double(c) if isinstance(dtype, (DoubleType, FloatType)) else c.cast("string"), F.lit("null"))
    raise TypeError(f"no JSON form for {dtype.simpleString()}")


def python_json_line(df, columns=None) -> Column:
    """A whole row as one ``json.dumps(record)`` line (keys in column order, nested structs kept)."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if columns is not None:
        order = {c: i for i, c in enumerate(columns)}
        fields.sort(key=lambda f: order[f.name])
    parts = []
    for i, f in enumerate(fields):
        parts += [F.lit(("" if i == 0 else ", ") + '"' + f.name + '": '), python_json_value(F.col(f.name), f.dataType)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def python_json_pretty(c: Column, dtype, indent: int = 2, level: int = 0) -> Column:
    """A value as ``json.dump(obj, indent=2)`` lays it out (nested structs and arrays)."""
    from pyspark.sql.types import ArrayType, StructType

    pad, end = " " * (indent * (level + 1)), " " * (indent * level)
    if isinstance(dtype, StructType):
        if not dtype.fields:
            return F.lit("{}")
        parts = []
        for i, f in enumerate(dtype.fields):
            parts += [F.lit(("" if i == 0 else ",\n") + pad + '"' + f.name + '": '),
                      python_json_pretty(c[f.name], f.dataType, indent, level + 1)]
        return F.when(c.isNull(), F.lit("null")).otherwise(
            F.concat(F.lit("{\n"), *parts, F.lit("\n" + end + "}")))
    if isinstance(dtype, ArrayType):
        items = F.transform(c, lambda x: F.concat(F.lit(pad), python_json_pretty(x, dtype.elementType, indent, level + 1)))
        return (F.when(c.isNull(), F.lit("null")).when(F.size(c) == 0, F.lit("[]"))
                .otherwise(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n" + end + "]"))))
    return python_json_value(c, dtype)


__all__ = ["render_template", "pretty_json", "struct_fields", "python_list_text", "json_value",
           "python_json_string", "python_json_value", "python_json_line", "python_json_pretty"]
