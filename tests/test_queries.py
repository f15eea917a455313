"""Each registered query of the event engine against its SQL twin."""

import math
from datetime import datetime

import pytest
from conftest import SF

from tidewheel.plans import catalog


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def rows(cols, data):
    return sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns
