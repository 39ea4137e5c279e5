"""Every registered query against its SQL, on all rows of the smallest tables."""

import os

import pytest
from compare import compare, connect

from genesieve.catalog import registry

SF_DIR = os.environ.get("GENESIEVE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(registry()))
def test_query(spark, duck, name):
    assert compare(spark, duck, registry()[name], SF_DIR) == ""
