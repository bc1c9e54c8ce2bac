"""Every registered query outside of the training-data operators against its SQL."""

import re
from pathlib import Path

import pytest

from tests.harness import connect, same
from veilframe.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, sf, name):
    same(spark, con, sf, QUERIES[name], ORACLE_SQL[name])


def test_every_other_query_has_a_plain_version():
    """Queries without SQL are held against plain versions in another module, by name."""
    text = (Path(__file__).parent / "test_truth.py").read_text()
    by_number = {name for name in QUERIES if re.fullmatch(r"det_(0[1-9]|1[0-7])_\w+", name)}
    assert sorted(name for name in set(QUERIES) - set(ORACLE_SQL) - by_number if name not in text) == []


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and df.columns == ["doc_id", "masked", "n_masked"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
