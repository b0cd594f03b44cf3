"""Order-insensitive comparison of a Spark result with a DuckDB oracle result."""

from __future__ import annotations

import math


def _norm(v, digits=None):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.{digits}g}") if digits else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def canonical_rows(cols, data, digits=None):
    """Rows with columns sorted by name, values normalised, rows sorted."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(scols, sdata, dcols, ddata, digits=9) -> list[str]:
    """Differences between two results (empty list when they agree)."""
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns {sorted(scols)} != {sorted(dcols)}")
    if len(sdata) != len(ddata):
        problems.append(f"rows {len(sdata)} != {len(ddata)}")
    if not problems:
        a, b = canonical_rows(scols, sdata, digits), canonical_rows(dcols, ddata, digits)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            problems.append(f"values {diff}")
    return problems


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
                 "smallint": "SMALLINT", "tinyint": "TINYINT"}


def duck_type(spark_type: str) -> str:
    """DuckDB name of a Spark simple type string (``df.dtypes``)."""
    if spark_type.startswith("array<"):
        return duck_type(spark_type[6:-1]) + "[]"
    if spark_type.startswith("decimal"):
        return spark_type.upper().replace(" ", "")
    return SPARK_TO_DUCK.get(spark_type, spark_type)


def type_mismatches(spark_dtypes, duck_columns, duck_types) -> dict:
    d = {c: str(t).upper().replace(" ", "") for c, t in zip(duck_columns, duck_types)}
    return {c: (duck_type(t), d.get(c)) for c, t in spark_dtypes if duck_type(t) != d.get(c)}
