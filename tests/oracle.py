"""Runs a query and its SQL on the same files and compares the rows."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return x
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def compare(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    assert len(mine) == len(theirs)
    bad = [(a, b) for a, b in zip(mine, theirs) if [None if x is None else x for x in a] != list(b) and not all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-6)) for p, q in zip(a, b))]
    assert not bad, bad[:2]
    return mine
