"""Rows of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import decimal
import glob
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def form(v) -> str:
    if hasattr(v, "asDict"):
        v = v.asDict(True)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return repr(sorted((str(k), form(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(form, v)) + "]"
    if isinstance(v, float | decimal.Decimal):
        v = float(v)
        return "nan" if v != v else f"{v + 0.0:.9g}"
    return "~" if v is None else str(v)


def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def same(spark, name, queries, sql) -> None:
    df = queries[name](spark, DATA)
    columns = sorted(df.columns)
    own = sorted(tuple(form(r[c]) for c in columns) for r in df.collect())
    result = duck().execute(sql[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(form(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert own == theirs
