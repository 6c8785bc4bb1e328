"""Every query with SQL gives the rows of its SQL."""

import oracle
import pytest

from corvane.plans import activity, base, checks, facts, planted, pricing, registry, relational, resources, search, text, values  # noqa: F401


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        assert oracle.same(df, con, registry.ORACLES[name]) is None
    else:
        assert df.columns and df.count() >= 0
