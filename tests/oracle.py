"""Runs queries beside their SQL, as the driver does, and compares rows without order."""

import math
from pathlib import Path

import duckdb


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) or hasattr(v, "is_finite"):
        return round(float(v), 6)
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


def connection(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def compare(con, sql, frame):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(names)
    assert sorted(frame.columns) == order
    want = sorted((tuple(normal(r[names.index(n)]) for n in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(normal(r[n]) for n in order) for r in frame.collect()), key=repr)
    assert got == want
