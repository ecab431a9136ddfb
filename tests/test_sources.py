import json
import time

from pyspark.sql import functions as F

from textquarry.operators import graph_store as g
from textquarry.operators.catalog import PROVIDERS
from textquarry.sources import readers
from textquarry.streaming import guard


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert [r.x for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()] == [1, 2]
    (tmp_path / "env2").write_text("# c\nexport A='x y'\nB=2\n1BAD=3\nC=\"q\\\"r\"\n")
    assert dict(map(tuple, readers.dotenv(spark, str(tmp_path / "env2")).collect())) == {"A": "x y", "B": "2", "C": 'q"r'}
    bodies = spark.createDataFrame([('{"models":[{"name":"m1"}]}', '{"data":[{"id":"o1"},{"id":"o2"}]}')], "a string, b string")
    assert [r.id for r in readers.model_list(bodies, "a", "ollama").collect()] == ["m1"] and readers.model_list(bodies, "b", "openai").count() == 2
    (tmp_path / "c.json").write_text(json.dumps([{"id": "p", "category": "c", "key_var": "K", "models": [{"id": "m", "cost": {"input": 1.5}}]}, {"id": "q"}]))
    p = readers.catalogue(spark, str(tmp_path / "c.json"))
    assert p.columns == [c.split()[0] for c in PROVIDERS.split(", ")][1:] + ["pos"] and [r.id for r in p.orderBy("pos").collect()] == ["p", "q"]
    readers.write_catalogue(p, str(tmp_path / "out"))
    assert [r.id for r in readers.catalogue(spark, str(tmp_path / "out"), lines=True).orderBy("pos").collect()] == ["p", "q"]


def test_graph_round_trip(spark, tmp_path):
    n = g.fill_defaults(spark.createDataFrame([("b", "t"), ("a", "u")], "id string, title string"))
    e = spark.createDataFrame([("e", "a", "b", "r", 1.0, "")], g.EDGES)
    assert readers.copy_graph(n, e, str(tmp_path / "g"), dry_run=True) == {"nodes": 2, "edges": 1} and not (tmp_path / "g").exists()
    readers.copy_graph(n, e, str(tmp_path / "g"))
    a, b = readers.read_graph(spark, str(tmp_path / "g"))
    assert sorted(a.collect()) == sorted(n.collect()) and b.collect() == e.collect()


def _drain(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "d"))
    live = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "d"))
    pick = lambda df: sorted(tuple(r) for r in df.select("doc_id", F.md5("masked"), "sensitivity", "injection", "failure").collect())
    assert pick(_drain(guard.guard(live), "guarded", spark)) == pick(guard.guard(docs))
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.txt").write_text('data: {"choices":[{"delta":{"content":"hi"}}]}\n: ping\ndata: [DONE]\n')
    assert [r.content for r in _drain(guard.decode_events(spark.readStream.text(str(tmp_path / "l"))), "events_in", spark).collect()] == ["hi"]
    rows = spark.createDataFrame([("a", "x", 0), ("b", "x", 3600), ("c", "y", 7200)], "id string, title string, s long").select("id", "title", F.timestamp_seconds("s").alias("updated_at"))
    rows.write.parquet(str(tmp_path / "t"))
    once = _drain(guard.dedup_titles(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t")), 24), "titles", spark)
    assert sorted(r.title for r in once.collect()) == ["x", "y"]
    cache = spark.createDataFrame([("k", int(time.time())), ("old", 5)], "key string, s long").select("key", F.timestamp_seconds("s").alias("stored"))
    assert [r.key for r in guard.live(cache, "stored", 3600).collect()] == ["k"]


def test_accumulated_answers(spark, tmp_path):
    schema = "stream_id string, seq long, kind string, content string, total_tokens long"
    first = [("a", 1, "delta", "Hel", None), ("a", 2, "delta", "lo", None), ("b", 1, "reasoning", "hm", None), ("a", 4, "done", None, None), ("a", 3, "usage", None, 7)]
    second = [("b", 2, "delta", "x", 5), ("b", 3, "done", None, None), ("b", 4, "delta", "next", None), ("c", 1, "delta", "open", None)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = guard.accumulate(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))

    def drain():
        q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(live.schema).parquet(str(tmp_path / "out")).collect())

    assert drain() == [("a", "Hello", "", 7, True)]
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert drain() == [("a", "Hello", "", 7, True), ("b", "x", "hm", 5, True)]  # state lived on; c and b's next are open
