import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same

NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir.replace("sf0.001", "sf0.01"))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir.replace("sf0.001", "sf0.01"))
    if name in entry.oracle_sql():
        same(df, con, entry.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
