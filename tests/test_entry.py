import os

import pytest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
