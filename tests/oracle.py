"""Compare a query's rows with its SQL's in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET threads = 4")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.5f}"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(str, map(plain, x))) + "]"
    if x is None:
        return "null"
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def compare(con, df, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns), (sorted(df.columns), sorted(found.columns))
    kinds = {n: str(t) for n, t in zip(found.columns, found.types, strict=True)}
    got, want = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, (len(wrong), wrong[:3], kinds)
    return len(got)
