import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from textquarry.operators import graph_store as g
from textquarry.sources import sqlite
from tests.test_versioned import edges, nodes, rows_of


def test_rows_filters_and_types(spark, tmp_path):
    path = str(tmp_path / "a.db")
    df = spark.range(1000).select(F.col("id").alias("n"), (F.col("id") / 4).alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t'\"é"), "id")).alias("t"), F.col("id").cast("string").cast("binary").alias("b"))
    sqlite.write(df.repartition(5), path, "some rows")
    back = sqlite.read(spark, path, "some rows", 7)
    assert back.dtypes == df.dtypes and rows_of(back.select("n", "x", "b")) == rows_of(df.select("n", "x", "b"))
    assert {r.n: r.t for r in back.collect()} == {r.n: r.t for r in df.collect()}
    assert back.rdd.getNumPartitions() == 7
    for where in ("n = 17", "n > 990 and x <= 249", "t = 't''\"é4'", "n in (3, 5, 7000)", "t is null and n < 10", "x + n = 5"):
        assert rows_of(back.filter(where).select("n")) == rows_of(df.filter(where).select("n"))
    sqlite.write(df.limit(3), path, "some rows")
    assert sqlite.read(spark, path, "some rows").count() == 1003
    sqlite.write(df.limit(2), path, "some rows", "overwrite")
    sqlite.write(df.limit(0), path, "none")
    assert sqlite.read(spark, path, "some rows").count() == 2 and sqlite.read(spark, path, "none").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        sqlite.read(spark, path, "other").collect()


def test_filters_are_left_to_the_file():
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    r = sqlite._Reader("p", "t", sqlite.StructType([]), 2)
    left = list(r.pushFilters([EqualTo(("a",), 5), In(("b",), ("x", "y")), StringStartsWith(("c",), "z")]))
    assert r.where == [('"a" = ?', [5]), ('"b" IN (?, ?)', ["x", "y"])] and len(left) == 1


def test_a_failed_task_leaves_the_target_as_it_was(spark, tmp_path):
    path = str(tmp_path / "a.db")
    sqlite.write(spark.range(10), path, "t")
    before = open(path, "rb").read()

    @F.udf("long")
    def bad(x):
        if x == 90:
            raise ValueError("no")
        return x

    with pytest.raises(Exception):  # noqa: B017
        sqlite.write(spark.range(100).select(bad("id").alias("id")), path, "t", "overwrite")
    assert open(path, "rb").read() == before and sqlite.read(spark, path, "t").count() == 10
    assert all(f == "a.db" or f.startswith("a.db.staging-") for f in os.listdir(tmp_path))


def test_graphs_go_out_and_back(spark, tmp_path):
    n, e = nodes(spark).withColumn("tags", F.array(F.lit("a"), F.col("id"))), edges(spark)
    path = str(tmp_path / "g.db")
    assert sqlite.copy_graph_to(n, e, path, dry_run=True) == {"nodes": 30, "edges": 30} and not os.path.exists(path)
    for _ in range(2):  # a second copy takes the place of the first
        assert sqlite.copy_graph_to(n, e, path) == {"nodes": 30, "edges": 30}
    a, b = sqlite.copy_graph_from(spark, path)
    assert sorted(map(str, a.collect())) == sorted(map(str, g.fill_defaults(n).collect())) and rows_of(b) == rows_of(e)
    with sqlite3.connect(path) as c:
        c.execute("ALTER TABLE nodes DROP COLUMN valid_until")
    assert sqlite.copy_graph_from(spark, path)[0].filter("valid_until = ''").count() == 30


def test_large_tables_are_read_in_more_ranges(tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (n INTEGER)")
        c.executemany("INSERT INTO t VALUES (?)", [(i,) for i in range(1000)])
    r = sqlite._Reader(path, "t", sqlite.StructType([sqlite.StructField("n", sqlite.LongType())]), None)
    assert len(r.partitions()) == 8
    r.rows = (10, 3)
    batches = [b for p in r.partitions() for b in r.read(p)]
    assert len(r.partitions()) == 100 and max(b.num_rows for b in batches) == 3
    assert [n for b in batches for n in b.column(0).to_pylist()] == list(range(1000))
