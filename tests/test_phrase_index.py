import random
import time

import pytest
from pyspark.sql import functions as F

from textquarry.operators import search
from textquarry.operators.phrase_index import PhraseIndex, cover, gram_of

SCHEMA = "id string, title string, body string, tags array<string>, importance double"


def made(n=200, seed=1):
    rng = random.Random(seed)
    words = ["Banana", "ana", "nan", "매수", "매수신호", "ABAB", "abab", "don't", "a.b", "x", "😀😀😀😀"]
    for i in range(n):
        yield f"n{i}", " ".join(rng.choices(words, k=2)), "".join(rng.choices(words + [" "], k=rng.randrange(12))) if i % 9 else None, rng.sample(["ana", "rust", "매수"], k=rng.randrange(3)), rng.randrange(4) / 4


def ranked(df):
    return [(r.id, pytest.approx(r.bm25, abs=1e-12)) for r in df.select("id", "bm25").collect()]


PHRASES = ["ana", "NANA", "abab", "매수신", "😀😀😀", "banana", "a.b", "don't", "ana b", "ab", "", "nowhere", "zzz"]


def test_same_rows_and_scores_as_the_scan(spark, tmp_path):
    df = spark.createDataFrame(list(made()), SCHEMA)
    index = PhraseIndex.build(df, str(tmp_path / "index"), buckets=8)
    for q in PHRASES:
        assert [(r.id, r.bm25) for r in index.search(q).collect()] == ranked(search.bm25_search(df, q))
    assert [r.id for r in index.search("ana", 5).collect()] == [r.id for r in search.bm25_search(df, "ana", 5).collect()]


def test_texts_are_not_read_and_few_buckets_are(spark, tmp_path):
    index = PhraseIndex.build(spark.createDataFrame(list(made()), SCHEMA), str(tmp_path / "index"), buckets=64)
    plan = index.search("banana")._jdf.queryExecution().toString()
    assert "body" not in plan and "title" not in plan
    read = {f for f in index.occurrences("banana").inputFiles() if f.split("/_bucket")[0] in {x.split("/_bucket")[0] for x in index.store.read("postings").inputFiles()}}
    assert len(read) <= 4 < len(index.store.read("postings").inputFiles())


def test_upserts_and_deletes_keep_it_up(spark, tmp_path):
    rows = {r[0]: r for r in made()}
    index = PhraseIndex.build(spark.createDataFrame(list(rows.values()), SCHEMA), str(tmp_path / "index"), buckets=8)
    new = [(i, t, b, g, 0.9) for i, (_, t, b, g, _) in zip(["n3", "n4", "n500"], made(3, 7), strict=True)]
    assert index.upsert(spark.createDataFrame(new, SCHEMA)) == 2
    assert index.delete(spark.createDataFrame([("n9",), ("n10",), ("no",)], "id string")) == 3
    rows.update({r[0]: r for r in new})
    rows = {i: r for i, r in rows.items() if i not in ("n9", "n10")}
    df = spark.createDataFrame(list(rows.values()), SCHEMA)
    anew = PhraseIndex.build(df, str(tmp_path / "anew"), buckets=8)
    live = lambda x: sorted(map(str, x.store.read("postings").join(x.store.read("docs").select("id", "segment"), ["id", "segment"], "left_semi").select("gram", "id", "field", "positions").collect()))
    assert live(index) == live(anew)
    for q in PHRASES:
        assert [(r.id, r.bm25) for r in index.search(q).collect()] == ranked(search.bm25_search(df, q))
    before = index.store.read("postings").count()
    index.compact()
    assert index.store.read("postings").count() == anew.store.read("postings").count() < before
    assert [(r.id, r.bm25) for r in index.search("ana").collect()] == ranked(search.bm25_search(df, "ana"))


def test_covers_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(200):
        q = "".join(rng.choices("abcdefgh", k=rng.randrange(3, 9)))
        n = {gram_of(q[i : i + 3]): rng.randrange(1, 50) for i in range(len(q) - 2)}
        cost = lambda at: sum(n[gram_of(q[i : i + 3])] for i in at)
        subsets = [[i for i in range(len(q) - 2) if m >> i & 1] for m in range(1 << len(q) - 2)]
        best = min(cost(at) for at in subsets if {j for i in at for j in (i, i + 1, i + 2)} == set(range(len(q))))
        at = cover(n, q)
        assert cost(at) == best and {j for i in at for j in (i, i + 1, i + 2)} == set(range(len(q)))


def test_long_bodies_take_linear_time(spark, tmp_path):
    df = spark.createDataFrame([("a", "t", "password aa" * 100_000, [], 0.5), ("b", "u", "x" * 1_000_000, [], 0.5)], SCHEMA)
    search.bm25_search(df.limit(0), "password").collect()
    began = time.time()
    assert [r.id for r in search.bm25_search(df, "Password").collect()] == ["a"]
    assert df.select(search._occurrences(F.col("body"), "aaP")).first()[0] == 99_999
    assert df.select(search._occurrences(F.col("body"), "xxx").alias("n")).agg(F.max("n")).first()[0] == 999_998
    assert time.time() - began < 20
    index = PhraseIndex.build(df, str(tmp_path / "index"), buckets=4)
    assert [r.tf for r in index.occurrences("aapassword").collect()] == [99_999]


def test_empty_table(spark, tmp_path):
    index = PhraseIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "index"))
    assert index.search("anything").collect() == []
    assert index.upsert(spark.createDataFrame([("a", "anything", None, None, 1.0)], SCHEMA)) == 2
    assert [r.id for r in index.search("ANY").collect()] == ["a"]


def test_a_gram_is_one_row_for_each_block_of_nodes(spark, tmp_path, monkeypatch):
    """Not one for each node, and a block is cut only where the next node no longer fits."""
    monkeypatch.setattr("textquarry.operators.phrase_index.BLOCK_CHARS", 300)
    df = spark.createDataFrame([(f"n{i:02}", "t", "Banana 매수신호 " + "x" * (i % 3 * 50), None, 0.5) for i in range(40)], SCHEMA).coalesce(1)
    index = PhraseIndex.build(df, str(tmp_path / "index"), buckets=4)
    stored = spark.read.parquet(*index.store.read("postings").inputFiles())
    assert stored.filter(F.col("gram") == gram_of("매수신")).count() < 20 < index.store.read("postings").filter(F.col("gram") == gram_of("매수신")).count() == 40
    at = {r.id: list(r.positions) for r in index.store.read("postings", keys=[gram_of("ana")]).collect()}
    assert at == {f"n{i:02}": [1, 3] for i in range(40)}
    assert [r.tf for r in index.occurrences("XXX").orderBy("id").limit(4).collect()] == [48, 98, 48, 98]
    index.delete(df.filter("id < 'n30'").select("id"))
    index.compact()
    assert sorted(r.id for r in index.occurrences("수신호").collect()) == [f"n{i}" for i in range(30, 40)] == sorted(r.id for r in index.store.read("postings", keys=[gram_of("수신호")]).collect())
