"""Comparison of Spark rows with DuckDB rows."""

from __future__ import annotations

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v


def assert_same(df, duck, sql):
    """The rows of df and of the SQL are the same, whatever their order; columns go by name."""
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(_norm(dict(zip(names, r))[n]) for n in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(_norm(r[n]) for n in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
