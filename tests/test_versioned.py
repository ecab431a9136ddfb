import threading

import pytest
from pyspark.sql import functions as F

from textquarry.operators import graph_store as g
from textquarry.sources import graph_tables as G
from textquarry.sources.versioned import Conflict, NewerSchema, Store

KV = "k long, v string"


def upsert(old, new):
    return old.join(new.select("k"), "k", "left_anti").unionByName(new)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "tables"))
    t = s.begin()
    t.write("t", spark.createDataFrame([(i, "a") for i in range(100)], KV), "k", 8)
    assert t.commit() == 1
    return s


def test_versions_and_touched_buckets(spark, store):
    new = spark.createDataFrame([(5, "b"), (1000, "c")], KV)
    assert store.run(lambda t: t.merge("t", new, upsert)) == 2
    assert rows_of(store.read("t", 1)) == [(i, "a") for i in range(100)]
    assert rows_of(store.read("t")) == sorted([(i, "b" if i == 5 else "a") for i in range(100)] + [(1000, "c")])
    gone, came = store.changed_files("t", 1, 2)
    assert 1 <= len(gone) <= len(came) <= 2
    assert rows_of(store.read("t", keys=[5, 7, 5000])) == [(5, "b"), (7, "a")]
    assert len(store.read("t", keys=[5]).inputFiles()) == 1
    with pytest.raises(ValueError):
        store.read("t", 9)
    with pytest.raises(ValueError):
        store.read("other")


def test_two_writers(spark, store):
    a, b = store.begin(), store.begin()
    # Which keys share a bucket is up to the hash.
    of = {r.k: r.b for r in spark.range(100).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    same = next(k for k in range(1, 100) if of[k] == of[0])
    other = next(k for k in range(1, 100) if of[k] != of[0])
    a.merge("t", spark.createDataFrame([(0, "x")], KV), upsert)
    b.merge("t", spark.createDataFrame([(other, "y")], KV), upsert)
    b.append("t", spark.createDataFrame([(0, "beside")], KV))
    assert (a.commit(), b.commit()) == (2, 3)
    assert rows_of(store.read("t", keys=[0, other])) == sorted([(0, "x"), (0, "beside"), (other, "y")])

    a, b = store.begin(), store.begin()
    a.merge("t", spark.createDataFrame([(0, "first")], KV), upsert)
    b.merge("t", spark.createDataFrame([(same, "second")], KV), upsert)
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert store.version() == 4
    assert store.run(lambda t: t.merge("t", spark.createDataFrame([(same, "second")], KV), upsert)) == 5
    assert rows_of(store.read("t", keys=[0, same])) == sorted([(0, "first"), (same, "second")])


def test_writers_in_threads_lose_nothing(spark, store):
    def add(n):
        store.run(lambda t: t.merge("t", spark.createDataFrame([(n, f"w{n}"), (500 + n, f"w{n}")], KV), upsert), retries=50)

    threads = [threading.Thread(target=add, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.version() == 7
    assert rows_of(store.read("t")) == sorted([(i, f"w{i}" if i < 6 else "a") for i in range(100)] + [(500 + i, f"w{i}") for i in range(6)])


def test_a_writer_that_dies_leaves_no_trace(spark, store, monkeypatch):
    before = rows_of(store.read("t"))
    t = store.begin()
    t.merge("t", spark.createDataFrame([(5, "never")], KV), upsert)  # files are written, then the writer dies
    half = store.begin()
    half.merge("t", spark.createDataFrame([(6, "never")], KV), upsert)
    monkeypatch.setattr(type(store.files), "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        half.commit()  # the draft is there, the version is not
    monkeypatch.undo()
    assert store.version() == 1 and rows_of(store.read("t")) == before
    assert store.run(lambda t: t.merge("t", spark.createDataFrame([(7, "z")], KV), upsert)) == 2
    assert len(store.files.names("data")) == 4
    assert store.vacuum() == 2  # those of the two writers; the first version's other buckets are still in use
    assert rows_of(store.read("t")) == sorted((i, "z" if i == 7 else v) for i, v in before)
    with pytest.raises(ValueError):
        store.read("t", 1)


def test_rows_outside_of_the_touched_buckets_are_refused(spark, store):
    with pytest.raises(ValueError):
        store.begin().merge("t", spark.createDataFrame([(1, "x")], KV), lambda old, new: new.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(50)).cast("array<long>"))))
    empty = spark.createDataFrame([], KV)
    assert store.run(lambda t: t.merge("t", empty, upsert)) == 1  # nothing to do, no version


def nodes(spark, n=30):
    return g.fill_defaults(spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("note").alias("type"), F.concat(F.lit("T"), "id").alias("title"), F.lit("2024-01-01T00:00:00Z").alias("created"), F.lit("2024-01-02T00:00:00Z").alias("updated"), (F.col("id") / 100).alias("importance")))


def edges(spark, n=30):
    return spark.range(n).select(
        F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), (F.col("id") * 7 + 1) % n).alias("target"), F.lit("related").alias("relation"), F.lit(1.0).alias("weight"), F.lit("t").alias("ts")
    )


def test_graph_commits(spark, tmp_path):
    n, e = nodes(spark), edges(spark)
    graph = G.GraphTables.create(n, e, str(tmp_path / "graph"), 8)
    with pytest.raises(ValueError):
        G.GraphTables.create(n, e, str(tmp_path / "graph"))
    change = nodes(spark, 2).withColumn("title", F.lit("new")).withColumn("created", F.lit("2030")).withColumn("access_count", F.lit(9).cast("long")).withColumn("seq", F.monotonically_increasing_id())
    assert graph.upsert(change) == 2
    assert rows_of(graph.graph().nodes.select("id", "title", "created", "access_count")) == rows_of(g.upsert_nodes(n, change).select("id", "title", "created", "access_count"))
    more = spark.createDataFrame([("e1", "n9", "n3", "other", 1.0, "t", 0), ("x1", "n2", "n3", "other", 1.0, "t", 1), ("x2", "n2", "n3", "other", 2.0, "t", 2), ("x3", "n1", "n8", "related", 2.0, "t", 3)], "id string, source string, target string, relation string, weight double, ts string, seq long")
    assert graph.connect(more) == 3
    assert rows_of(graph.graph().edges) == rows_of(g.append_edges(e, more))
    assert [tuple(r) for r in graph.edges_of(["n2"], g.Direction.OUT).select("id").orderBy("id").collect()] == [("e2",), ("x1",)]
    assert rows_of(graph.edges_of(["n3"], g.Direction.IN).select("id")) == rows_of(graph.graph().edges.filter("target = 'n3'").select("id"))
    assert len(graph.nodes_of(["n3"]).inputFiles()) == 1
    assert graph.delete(["n2", "n3", "nobody"]) == 4
    want_n, want_e = g.delete_nodes(g.upsert_nodes(n, change), g.append_edges(e, more), ["n2", "n3"])
    assert rows_of(graph.graph().nodes.select("id")) == rows_of(want_n.select("id"))
    assert rows_of(graph.graph().edges) == rows_of(graph.store.read("edges_by_target")) == rows_of(want_e)
    assert graph.graph(1).nodes.count() == 30 and graph.graph(1).stats().count() >= 1
    assert graph.delete(["nobody"]) >= 4 and graph.graph().nodes.count() == 28


@pytest.mark.parametrize("old", [0, 1, 2, 3, 4])
def test_tables_of_every_older_schema_migrate_to_the_same_rows(spark, tmp_path, old):
    n, e = nodes(spark), edges(spark)
    lacking = [*(G._VALIDITY if old < 4 else ()), *(G._USE if old < 2 else ())]
    graph = G.GraphTables(spark, str(tmp_path / "graph"))
    t = graph.store.begin()
    t.write("nodes", n.drop(*lacking), "id", 4)
    t.write("edges", e, "source", 4)
    if old >= 3:
        t.write("edges_by_target", e, "target", 4)
    t.schema = old
    t.commit()
    assert graph.migrate() == 4
    assert graph.store.read("nodes").columns == n.columns
    assert rows_of(graph.store.read("nodes").select("id", "agents", "access_count", "accessed_at", "valid_until", "last_verified")) == rows_of(n.select("id", "agents", "access_count", "accessed_at", "valid_until", "last_verified"))
    assert rows_of(graph.store.read("edges_by_target")) == rows_of(e)
    version = graph.store.version()
    assert graph.migrate() == 4 and graph.store.version() == version  # a second run does nothing


def test_newer_schemas_are_refused_and_stopped_migrations_go_on(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    t = store.begin()
    t.write("t", spark.createDataFrame([(1, "a")], KV), "k", 2)
    t.schema = 9
    t.commit()
    with pytest.raises(NewerSchema):
        store.migrate([(1, lambda t: None), (4, lambda t: None)])

    def fails(t):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        store.migrate([(10, lambda t: None), (11, fails)])
    assert store.schema_version() == 10
    ran = []
    assert store.migrate([(10, lambda t: ran.append(10)), (11, lambda t: ran.append(11))]) == 11
    assert ran == [11]


def test_deletes_of_nodes_that_are_not_there_rewrite_no_nodes(spark, tmp_path):
    graph = G.GraphTables.create(nodes(spark), edges(spark), str(tmp_path / "graph"), 4, wide=True)
    change = nodes(spark, 9).withColumns({"title": F.lit("new"), "created": F.lit("2030"), "access_count": F.col("importance").cast("long") + 3, "seq": F.lit(0)})
    late = change.withColumn("seq", F.when(F.col("id") == "n1", F.lit(None)).otherwise(-5))
    for rows in (change, late):  # the second ones come before what is there
        want = rows_of(g.upsert_nodes(graph.graph().nodes, rows))
        graph.upsert(rows, wide=True)
        assert rows_of(graph.graph().nodes) == want
    graph.delete(["nobody", "n3"])
    gone, came = graph.store.changed_files("nodes", 3, 4)
    assert len({f.split("/_bucket=")[1].split("/")[0] for f in gone}) == 1 and graph.graph().nodes.count() == 29


def test_migrations_rewrite_no_nodes(spark, tmp_path):
    graph = G.GraphTables(spark, str(tmp_path / "graph"))
    t = graph.store.begin()
    t.write("nodes", nodes(spark).drop(*G._USE, *G._VALIDITY), "id", 4, shuffle=False)
    t.write("edges", edges(spark), "source", 4)
    t.schema = 1
    t.commit()
    graph.migrate()
    assert graph.store.changed_files("nodes", 1, graph.store.version()) == ([], [])
    assert rows_of(graph.store.read("nodes")) == rows_of(nodes(spark)) and rows_of(graph.nodes_of(["n3"])) == rows_of(nodes(spark).filter("id = 'n3'"))
    graph.upsert(nodes(spark, 1).withColumns({"access_count": F.lit(7).cast("long"), "seq": F.lit(0)}))
    assert graph.graph().nodes.select(F.sum("access_count"), F.count("agents")).first() == (7, 30)
