import math
import os

import duckdb
import pytest

from gridloom.plans import catalog
from gridloom.plans import queries as _queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: float(f"{v:.8g}") if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
