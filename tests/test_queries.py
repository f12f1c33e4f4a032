"""Every query of the core runs on the smallest tables and gives what its SQL gives there."""

import math
import os

import duckdb
import numpy as np
import pytest

from corvane.plans import registry

DATA = os.environ.get("CORVANE_TEST_DATA", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 4) + 0.0 if isinstance(v, (int, float, np.number)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    if name not in registry.oracle_sql():
        return
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    r = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str) == rows
