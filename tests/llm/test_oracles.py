import pytest

from tessera.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, sf_dir), SQL[name])


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    names = set(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
