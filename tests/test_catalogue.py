"""Every query of the library against its SQL on the smoke tables."""

import os

import pytest

from lodegraph.plans import catalogue

from .conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(name, spark, duck, compare):
    compare(catalogue.queries()[name](spark, DATA), duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql_runs(name, spark):
    assert catalogue.queries()[name](spark, DATA).columns


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
