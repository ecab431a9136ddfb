import pytest

from tests.oracle import connect, rows
from textquarry.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    cur = connect("/root/testdata/sf0.01").execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())
