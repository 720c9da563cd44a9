"""Every query runs on the smallest tables; those with SQL give the same rows in DuckDB."""

import pytest

import compare
from quire.plans import catalog, catalog_more  # noqa: F401  the second adds to the first


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf, name):
    names, got = compare.rows_of(catalog.QUERIES[name](spark, sf))
    if name not in catalog.SQL:
        assert names
        return
    rel = con.execute(catalog.SQL[name])
    cols = [d[0] for d in rel.description]
    assert names == sorted(cols)
    order = [cols.index(c) for c in sorted(cols)]
    assert got == sorted(tuple(compare.plain(r[i]) for i in order) for r in rel.fetchall())
