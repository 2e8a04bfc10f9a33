"""Rows of two engines, made alike."""

import math


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, got.fetchall())
