import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import vector_index as X
from textquarry.operators import vectors

SCHEMA = "id long, vector array<double>"


def table(spark, n=600, d=9, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    rows = [(i, (centers[rng.integers(12)] + rng.normal(size=d) * 0.3).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(30)]  # copies: ties
    rows += [(n + 40, None), (n + 41, [0.0] * d), (n + 42, [1.0]), (n + 43, [float("nan")] * d), (n + 44, [None] * d), (n + 45, [1e-300] * d), (n + 46, [1e200] * d)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, asks, k, skip):
    ok = lambda v, d: v is not None and len(v) == d and None not in v and np.isfinite(v).all() and np.any(v)
    unit = lambda v: (w := np.array(v) / np.abs(v).max()) / np.sqrt(w @ w)
    have = [(i, unit(v)) for i, v in rows if ok(v, 9)]
    out = []
    for q, v in asks:
        if ok(v, 9):
            u = unit(v)
            hits = sorted((-round(float(u @ w), 9), i) for i, w in have if not (skip and i == q))[:k]
            out += [(q, i, r, -s) for r, (s, i) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,pack,skip,cells", [(2000, 500, True, None), (20, 7, False, 5), (3, 500, True, 40)])
def test_join_equals_brute_force(spark, tmp_path, monkeypatch, block, pack, skip, cells):
    monkeypatch.setattr(X, "BLOCK", block)
    monkeypatch.setattr(X, "PACK", pack)
    df = table(spark)
    asks = df if skip else table(spark, 50, 9, 5)
    index = X.CellIndex.build(df, str(tmp_path / "index"), cells=cells)
    rows, queries = ([(r.id, r.vector) for r in x.collect()] for x in (df, asks))
    got = X.CellIndex.load(spark, str(tmp_path / "index")).knn(asks.withColumnRenamed("id", "query_id"), 5, probe=2, skip_self=skip)
    assert sorted((r.query_id, r.id, r["rank"], pytest.approx(r.score, abs=1e-8)) for r in got.collect()) == [(q, i, n, s) for q, i, n, s in brute(rows, queries, 5, skip)]
    assert index.blocks.agg(F.max(F.size("rows"))).first()[0] <= 6 * block and index.blocks.select(F.explode("rows.id")).distinct().count() == 632


def test_joins_of_empty_tables_and_few_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = X.CellIndex.build(none, str(tmp_path / "none"))
    assert index.knn(table(spark).withColumnRenamed("id", "query_id"), 3).count() == 0
    few = X.CellIndex.build(table(spark, 3).filter("id < 3"), str(tmp_path / "few"))
    assert few.knn(none.withColumnRenamed("id", "query_id"), 3).count() == 0
    got = few.knn(table(spark, 3).filter("id < 2").withColumnRenamed("id", "query_id"), 9)
    assert sorted((r.query_id, r["rank"]) for r in got.collect()) == [(q, n) for q in (0, 1) for n in (1, 2, 3)]


@pytest.mark.parametrize("bits,least", [(4, 0.95), (2, 0.9)])
def test_codes_find_what_is_near(spark, bits, least):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = df.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = X.Quantised.build(df, bits)
    assert index.bytes_a_vector == 64 * bits // 8 and {len(r.code) for r in index.codes.collect()} == {64 * bits // 8}
    got = {(r.query_id, r.id): r.score for r in index.search(df, queries, 10).collect()}
    want = {(r.query_id, r.id): r.score for r in vectors.knn(df, queries, 10).collect()}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= least * len(want)
    assert all(got[x] == pytest.approx(want[x]) for x in got.keys() & want.keys())


def test_codes_follow_added_and_removed_rows(spark):
    df = table(spark)
    index = X.Quantised.build(df, 4)
    assert index.codes.count() == 632  # those with a direction
    new = spark.createDataFrame([(5, [1.0] * 9), (9999, [1.0] * 9)], SCHEMA)
    changed = index.add(new).remove(spark.createDataFrame([(3,)], "id long"))
    rows = df.filter("id not in (3, 5)").unionByName(new)
    ask = spark.createDataFrame([(1, [2.0] * 9), (2, None)], "query_id long, vector array<double>")
    got = [(r.id, r["rank"]) for r in changed.search(rows, ask, 3).orderBy("rank").collect()]
    assert got[:1] == [(5, 1)] and 9999 in dict(got)
    assert changed.codes.count() == 632
    with pytest.raises(ValueError):
        X.Quantised.build(df, 3)
    assert X.Quantised.build(df.limit(0)).search(df, ask, 3).count() == 0


@pytest.mark.parametrize("groups,step,k", [(8, 1_000, 2), (2, 50, 7)])
def test_visits_are_no_rows_where_vectors_have_no_structure(spark, tmp_path, monkeypatch, groups, step, k):
    kept = {}
    cut = X.cut
    monkeypatch.setattr(X, "cut", lambda df, what: kept.setdefault((what, len(kept)), cut(df, what)))
    monkeypatch.setattr(X, "drop", lambda *tables: None)
    monkeypatch.setattr(X, "GROUPS", groups)
    monkeypatch.setattr(X, "STEP", step)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = X.CellIndex.build(df, str(tmp_path / "index"), cells=60)
    kept.clear()
    got = index.knn(df.withColumnRenamed("id", "query_id"), k, skip_self=True)
    assert sorted((r.query_id, r.id, r["rank"], pytest.approx(r.score, abs=1e-8)) for r in got.collect()) == [(q, i, n, s) for q, i, n, s in brute(rows, rows, k, True)]
    assert max(t.count() for t in kept.values()) <= max(4, k + 1) * len(rows)  # was a row for each of the cells that a query visits
