import pytest

from textquarry.functions import chunk, sql
from textquarry.operators import chat


def test_folds_in_sql_are_those_of_dataframes(spark):
    sql.register(spark)
    asks = spark.createDataFrame([("a", i, n, "x") for i, n in enumerate([5, 7, -3, None, 4, 100, 2])] + [("b", 1, 3, None), (None, 2, 9, "y")], "budget string, pos int, tokens long, note string")
    asks.createOrReplaceTempView("asks")
    got = spark.sql("SELECT * FROM reserve(TABLE(asks) PARTITION BY budget ORDER BY (pos), 10, 'tokens')")
    want = chunk.reserve(asks, 10)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    said = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(["assistant", "user", "user", None, "assistant", "tool"])] + [(2, 0, "system", "s"), (2, 1, "assistant", "no")], "conv_id long, turn long, role string, text string")
    said.createOrReplaceTempView("said")
    got = spark.sql("SELECT * FROM accept(TABLE(said) PARTITION BY conv_id ORDER BY (turn))")
    assert sorted(map(str, got.collect())) == sorted(map(str, chat.accept(said).collect()))
    docs = spark.createDataFrame([(1, "One two. Three four. Five six."), (2, None), (3, "")], "doc_id long, text string")
    docs.createOrReplaceTempView("docs")
    got = spark.sql("SELECT doc_id, nth, chunk FROM chunk_rows(TABLE(docs), 5, 1, 'text')").collect()
    assert sorted(map(tuple, got)) == [(1, i, c) for i, c in enumerate(chunk.chunks("One two. Three four. Five six.", chunk.ChunkOptions(5, 1)))]


@pytest.mark.parametrize("call", ["reserve(TABLE(asks), 10, 'nothing')", "reserve(TABLE(asks2), 10, 'tokens')", "reserve(1, 10, 'tokens')", "accept(TABLE(asks))", "chunk_rows(TABLE(asks), 5, 1, 'nothing')"])
def test_what_does_not_fit_is_an_error(spark, call):
    sql.register(spark)
    spark.createDataFrame([("a", 1, 2, "x")], "budget string, pos int, tokens long, note string").createOrReplaceTempView("asks")
    spark.createDataFrame([("a", 2, True)], "budget string, tokens long, granted boolean").createOrReplaceTempView("asks2")
    with pytest.raises(Exception):  # noqa: B017  Spark wraps what analyze raises
        spark.sql(f"SELECT * FROM {call}").collect()
