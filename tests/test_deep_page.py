"""Pages of any depth: the range of a row is searched for, not found by testing every mark."""

import pytest

from cohorta.operators.paging import deep_page, page


@pytest.mark.parametrize("order", ["ASC", "DESC"])
@pytest.mark.parametrize("by", [None, "g"])
def test_deep_page_searches_among_its_marks(spark, order, by):
    rows = [(None if i % 5 == 0 else "ab"[i % 2], None if i % 7 == 0 else i * 37 % 60, None if i == 50 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, id int")
    got = deep_page(df, "k", order, 9, 21, by=by or (), tie="id", ranges=8)
    plan = got._jdf.queryExecution().toString()
    assert "filter(_marks" not in plan
    expected = page(df, "k", order, 9, 21, by=by, tie="id")
    assert sorted(map(str, got.select("g", "k", "id").collect())) == sorted(map(str, expected.select("g", "k", "id").collect()))
    if by:
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(*got.columns).collect()))
