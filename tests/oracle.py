"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return str(value)


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def sort_key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def differences(df, sf_dir: str, sql: str) -> str:
    """An empty string if both give the same rows, else what differs first."""
    names, rows = duck_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    ours = sorted((tuple(normal(r[c]) for c in order) for r in df.collect()), key=sort_key)
    theirs = sorted((tuple(normal(r[names.index(c)]) for c in order) for r in rows), key=sort_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}; first {ours[:2]} {theirs[:2]}"
    for a, b in zip(ours, theirs):
        if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b)):
            return f"{order}: {a} against {b}"
    return "" if ours else "no rows"
