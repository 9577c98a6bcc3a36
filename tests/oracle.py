"""Order-insensitive comparison of a Spark query with its DuckDB twin."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    return v


def compare(spark_df, sql: str, con) -> str:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    cols = sorted(names)
    want = sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    if want == got:
        return ""
    extra = [r for r in got if r not in want][:2] if len(got) < 5000 else got[:1]
    lack = [r for r in want if r not in got][:2] if len(want) < 5000 else want[:1]
    return f"rows {len(got)} against {len(want)}; only here {extra}; only there {lack}"
