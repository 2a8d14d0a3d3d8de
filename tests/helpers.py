"""Spark rows and DuckDB rows, made comparable."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def duck(sf: str, sql: str):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def same(df, sf: str, sql: str) -> None:
    columns, rows = duck(sf, sql)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rows)


def joined(df) -> int:
    """Collects ``df``; the most rows that one of its joins made."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan"}.get(p.nodeName())
        children = p.children()
        plans += [getattr(p, inner)()] if inner else [children.apply(k) for k in range(children.size())]
    return most
