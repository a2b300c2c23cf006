"""Rows of a query against the rows of its SQL."""

import decimal
import math

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.9g}") if v else 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs
