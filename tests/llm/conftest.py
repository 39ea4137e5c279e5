import pytest

from genesieve.llm.common import reachable


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    reachable(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
