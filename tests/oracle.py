"""Holding a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "tolist"):
        return tuple(map(_plain, v.tolist()))
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)) if x is None else "", x if x is not None else 0) if not isinstance(x, tuple) else (False, "", str(x)) for x in r))


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs, empty if nothing does."""
    c = connect(sf_dir)
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    theirs, mine = rows(names, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if len(mine) != len(theirs):
        return [f"{len(mine)} rows and {len(theirs)}"]
    return [f"{a} and {b}" for a, b in zip(mine, theirs, strict=True) if not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))][:5]
