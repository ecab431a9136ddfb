import json
import random
import time

import pytest
from pyspark.sql import functions as F

from textquarry.plans import store_queries
from textquarry.streaming import guard, stateful

CHUNK = "stream_id long, seq long, bytes binary"
NODE = "id string, title string, updated long, seq long, clock long"


def streamed(spark, tmp_path, batches, schema, of, name):
    """The result of a stream whose batches are these lists of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        time.sleep(0.01)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = of(live).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        assert len([p for p in q.recentProgress if p.numInputRows]) == len(batches)
        return spark.table(name).collect()
    finally:
        q.stop()


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_lines_of_any_cut(spark, tmp_path, size):
    text = {1: "data: {\"a\": \"매수 😀\"}\r\n\n: note\ndata: é  \t\nrest", 2: "\n", 3: "no end", 4: "ü\n" * 5}
    rows = [(s, i, t.encode()[i : i + size]) for s, t in text.items() for i in range(0, len(t.encode()), size)]
    rows.sort(key=lambda r: (r[1], r[0]))
    cut = max(1, len(rows) // 3)
    batches = [rows[:cut], rows[cut : 2 * cut], rows[2 * cut :]]
    for b in batches:
        random.Random(size).shuffle(b)
    got = streamed(spark, tmp_path, [b for b in batches if b], CHUNK, stateful.lines, f"lines{size}")
    want = sorted((s, n, line.rstrip()) for s, t in text.items() for n, line in enumerate(t.split("\n")[:-1]))
    assert sorted(tuple(r) for r in got) == want


def test_events_of_chunks(spark, tmp_path):
    events = [{"choices": [{"delta": {"content": c}}]} for c in ("안녕", " wörld", "!")]
    body = b"".join(b"data: " + json.dumps(e, ensure_ascii=False).encode() + b"\n\n" for e in events) + b"data: [DONE]\n"
    rows = [(1, i, body[i : i + 5]) for i in range(0, len(body), 5)]
    got = streamed(spark, tmp_path, [rows[:10], rows[10:11], rows[11:]], CHUNK, lambda live: guard.decode_events(stateful.lines(live)), "chunked")
    assert [(r.kind, r.content) for r in sorted(got, key=lambda r: r.nth)] == [("delta", "안녕"), ("delta", " wörld"), ("delta", "!")]


def test_titles_block_for_a_window(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"n{i}", rng.choice(["a", "b", "c", None]), 1000 * i - rng.randrange(2000), i, 1000 * i) for i in range(60)]
    want, last = [], {}
    for i, title, updated, _, clock in rows:
        block = title in last and last[title][1] > clock - 5000
        if not block:
            last[title] = (i, updated)
        want.append((i, title, updated, not block, last[title][0]))
    got = streamed(spark, tmp_path, [rows[:25], rows[25:26], rows[26:]], NODE, lambda live: stateful.dedup_nodes(live, 5000, "clock"), "titles")
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert 0 < sum(r.kept for r in got) < 60


def test_state_ends_by_itself(spark, tmp_path):
    path, now = str(tmp_path / "in"), int(time.time() * 1000)
    spark.createDataFrame([(f"x{i}", f"t{i}", now, i, 0) for i in range(20)], NODE).coalesce(1).write.parquet(path + "/a")
    live = spark.readStream.schema(NODE).option("recursiveFileLookup", True).parquet(path)
    q = stateful.dedup_nodes(live, 1500, ttl_ms=1500).writeStream.format("memory").queryName("expiring").outputMode("append").start()
    # With a time-out batches go on, so the query is watched instead of waited for.
    held = lambda: q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress and q.lastProgress.stateOperators else -1

    def until(done):
        deadline = time.time() + 60
        while not done() and time.time() < deadline:
            assert q.exception() is None
            time.sleep(0.2)
        assert done()

    try:
        until(lambda: spark.table("expiring").count() == 20)
        until(lambda: held() == 0)
        spark.createDataFrame([("y", "t3", int(time.time() * 1000), 99, 0)], NODE).coalesce(1).write.parquet(path + "/b")
        until(lambda: spark.table("expiring").count() == 21)
        assert {r.id: r.kept for r in spark.table("expiring").filter(F.col("title") == "t3").collect()} == {"x3": True, "y": True}
    finally:
        q.stop()


def test_batches_of_many_files_come_whole_and_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_queries, "_anew", lambda spark, what: f"{tmp_path}/{what}")
    rows = spark.range(600).selectExpr("id % 7 as stream_id", "id as seq", "cast(concat(id, '\n') as binary) as bytes").repartition(5)
    got = store_queries._streamed(spark, rows, F.floor(F.col("seq") / 200), 3, stateful.lines, "many").collect()
    for i in range(7):
        assert [int(r.value) for r in sorted((r for r in got if r.stream_id == i), key=lambda r: r.nth)] == list(range(i, 600, 7))
    for b in range(3):  # was one file, by one task
        assert len(list((tmp_path / f"many/in/b{b}").glob("*.parquet"))) == 5
    assert len(list((tmp_path / "many/log/commits").glob("[0-9]"))) == 3
