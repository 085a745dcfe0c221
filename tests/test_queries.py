"""Every registered query against its SQL on the smallest data set."""

import pytest
from compare import differences, duck

from codeaudit.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    diff, n = differences(spark, con, SF, name)
    assert diff == []


def test_every_query_but_documents_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"export_json", "export_markdown"}
