"""Side-by-side check of a registered query against its DuckDB SQL.

Used by the tests and during development: row count, column names and an
order-insensitive comparison of values (columns sorted by name).
"""

from __future__ import annotations

import datetime as _dt
import decimal as _dec
import math
import os

from ..sources.tables import TABLES, table_path


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def type_mismatches(sdf, con, sql: str) -> list:
    """Columns whose Spark type has no equal DuckDB type in the oracle result."""
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(c, t, duck.get(c)) for c, t in sdf.dtypes if _SPARK_TO_DUCK.get(t, t) != duck.get(c)]


def _norm(v, digits: int | None):
    if v is None:
        return None
    if isinstance(v, _dec.Decimal):
        return ("decimal", str(v))  # never equal to a float: hashes differ too
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def _rows(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, query_fn, sql: str, con=None) -> dict:
    """Run both sides; return counts, column lists and exact / 9-digit value agreement."""
    con = con or duckdb_connection(sf_dir)
    sdf = query_fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {
        "name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "spark_columns": s_cols, "oracle_columns": d_cols,
    }
    if out["columns_match"]:
        a, b = _rows(s_cols, s_rows, None), _rows(d_cols, d_rows, None)
        out["exact"] = a == b
        a9, b9 = _rows(s_cols, s_rows, 9), _rows(d_cols, d_rows, 9)
        out["close"] = a9 == b9
        if not out["close"]:
            diff = [(x, y) for x, y in zip(a9, b9) if x != y][:3]
            out["first_diffs"] = diff
    return out
