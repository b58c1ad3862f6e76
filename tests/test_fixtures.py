"""The fixture tables built with the DataFrame API equal their SQL definitions."""
import pytest

from turfline.plans.oracle import FX_ORDER, with_fx
from turfline.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def _canon(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", FX_ORDER)
def test_fixture_matches_sql(spark, duck, name):
    df = getattr(FX, name)(spark, SF)
    cols = df.columns
    srows = [tuple(r) for r in df.select(*cols).collect()]
    cur = duck.execute(with_fx([name], f"SELECT {', '.join(cols)} FROM {name}"))
    drows = cur.fetchall()
    assert _canon(srows) == _canon(drows)
