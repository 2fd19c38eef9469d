import pytest
from compare_rows import assert_same

from stillwater.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
