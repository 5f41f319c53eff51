"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import pytest

from evgraph.plans import catalog

NAMES = sorted(catalog.queries())


def rows(cols, data):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, want.fetchall())
