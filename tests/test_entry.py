"""The driver contract: entry() runs, every query has a plan, and each oracle agrees at sf0.001."""

import math

import duckdb

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["file_path", "line_number", "line_content"] and df.count() > 0


def test_every_oracle_matches(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 45
    bad = []
    for name, fn in qs.items():
        df = fn(spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
        if name not in sql:
            continue
        cur = con.execute(sql[name])
        dcols = [d[0] for d in cur.description]
        if sorted(df.columns) != sorted(dcols) or canon(df.columns, rows) != canon(dcols, cur.fetchall()):
            bad.append(name)
    assert bad == []
