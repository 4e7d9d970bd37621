"""Compare a DataFrame's rows with DuckDB's, order aside and floats to nine digits."""

import decimal
import math

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(df, result):
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [result.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
