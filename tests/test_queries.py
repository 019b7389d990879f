"""Every core query against its SQL, on the smallest tables."""

import pytest
from harness import same

from foliospark.plans import catalog, problems, quantities, site

CORE = {k: f for m in (quantities, problems, catalog, site) for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in (quantities, problems, catalog, site) for k, q in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    mine, theirs = same(spark, sf, CORE[name], ORACLE[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(CORE) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    assert CORE[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
