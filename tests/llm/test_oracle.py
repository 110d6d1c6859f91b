import pytest
from compare import check, database

from loomwork.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    check(queries.queries()[name](spark, FOLDER), database(FOLDER), queries.oracle_sql()[name])
