import pytest
from harness import same

from foliospark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_columns(spark, sf):
    want = {"p6_found": {"field", "key_a", "key_b"}, "p7_ids": {"doc_id", "ids"}, "p9_found": {"doc_id", "sent_start", "sent_end"}}
    for k, v in want.items():
        assert set(queries.QUERIES[k](spark, sf).columns) == v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    mine, theirs = same(spark, sf, queries.QUERIES[name], queries.SQL[name])
    assert mine == theirs
