import os

import pytest

SF = "/root/testdata/sf0.001"


def rows(found):
    return sorted(tuple(r) for r in found)


def by_sql(name):
    """What DuckDB makes of a query's SQL."""
    import duckdb

    from kairograph import registry

    with duckdb.connect() as db:
        for file in os.listdir(SF):
            db.execute(f"CREATE VIEW {file.partition('.')[0]} AS SELECT * FROM '{SF}/{file}'")
        return rows(db.execute(registry.oracle_sql()[name]).fetchall())


def by_spark(spark, name):
    from kairograph import registry

    return rows(registry.queries()[name](spark, SF).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_facts_of_events_as_of_a_date(spark):
    got = by_spark(spark, "asof_facts")
    assert got and got == by_sql("asof_facts")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_facts_of_events_that_expire_later(spark):
    got = by_spark(spark, "asof_facts_strict")
    assert got and got == by_sql("asof_facts_strict")


def test_no_function_of_the_queries_hides_another():
    import ast

    from kairograph.plans import queries, written

    for module in (queries, written):
        with open(module.__file__) as file:
            names = [x.name for x in ast.parse(file.read()).body if isinstance(x, ast.FunctionDef)]
        assert sorted(names) == sorted(set(names))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["rerank_scores", "ranked_by_label"])
def test_joins_with_hits_know_their_size_and_search_once(spark, name):
    from kairograph import registry

    found = registry.queries()[name](spark, SF)
    assert "InArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = rows(found.collect())
    assert got and got == by_sql(name)
