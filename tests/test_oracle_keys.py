"""Every oracle-backed catalog key equals its DuckDB SQL at sf0.001."""
import math

import pytest

from turfline.plans.catalog import load_all

REG = load_all()
ORACLE_KEYS = sorted(k for k, e in REG.items() if e.oracle() is not None)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_key_matches_oracle(spark, duck, key):
    from conftest import SF_SMALL

    e = REG[key]
    df = e.query(spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(e.oracle())
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _canon(srows, df.columns) == _canon(drows, dcols)


def test_every_key_has_a_builder():
    assert len(REG) >= 100
    for k, e in REG.items():
        assert callable(e.build), k
