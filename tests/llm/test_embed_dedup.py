import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import embed_dedup as E


def brute(rows, least=0.93):
    ok = []
    for i, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            ok.append((i, label, u / np.linalg.norm(u)))
    n, up = [0] * len(rows), {i: i for i in range(len(rows))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a, u) in enumerate(ok):
        for j, b, w in ok[k + 1 :]:
            if a == b and len(u) == len(w) and u @ w >= least:
                n[i] += 1
                n[j] += 1
                x, y = sorted((root(i), root(j)), key=lambda t: rows[t][0])
                up[y] = x
    return {rows[i][0]: (n[i], rows[root(i)][0], rows[root(i)][0] == rows[i][0]) for i in range(len(rows))}


def cases():
    rnd = np.random.default_rng(8)
    rows = []
    for c in range(30):
        base = rnd.normal(size=16)
        for _ in range(int(rnd.choice([1, 4, 60]))):
            rows.append(((base + rnd.normal(size=16) * rnd.choice([0.1, 0.3])).tolist(), c % 3))
    rows += [(rows[0][0], rows[0][1])] * 5 + [([2 * x for x in rows[0][0]], rows[0][1]), (rows[0][0], None), (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1e300] * 16, 1), ([None] * 16, 2), ([1.0, 2.0], 1), ([1.0, 2.1], 1), ([], 1)]
    order = rnd.permutation(len(rows))
    return [(int(i), *rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("shard", [3_000, 40])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(E, "SHARD_ROWS", shard)
    monkeypatch.setattr(E, "CLUSTER_ROWS", 60)
    rows = cases()
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int, dim int")
    got = {r.vec_id: tuple(r)[1:] for r in E.link(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    assert np.mean([got[i] == want[i] for i in got]) > 0.97


@pytest.mark.parametrize("centroids", [1, 50])
def test_labels_that_are_searched_badly_are_compared_exactly(spark, monkeypatch, centroids):
    monkeypatch.setattr(E, "CLUSTER_ROWS", 40 if centroids > 1 else 10**6)
    monkeypatch.setattr(E, "SHARD_ROWS", 100)
    monkeypatch.setattr(E, "SMALL_LABEL", 100)
    rows = cases()
    reps = E.prepare(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).withColumnRenamed("vec_id", "rep").withColumn("m", F.lit(1).cast("long")).dropDuplicates(["g", "label"])
    none = spark.createDataFrame([], "rep long, n long")
    told = E.audit(reps, none, 0.93).collect()
    assert told and all(r.got == 0 for r in told) and {r.label for r in told if r.true} == {"0", "1", "2"}
    real = E._links
    monkeypatch.setattr(E, "_links", lambda reps, least, exact=False: real(reps, least, exact) if exact else real(reps, least).filter("label <> '1'"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = {r.vec_id: tuple(r)[1:] for r in E.link(df).collect()}, brute(rows)
    assert all(got[i] == want[i] for i, _, label in rows if label == 1)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())


def test_clusters_of_a_second_level(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_CENTROIDS", 4)
    monkeypatch.setattr(E, "CLUSTER_ROWS", 20)
    monkeypatch.setattr(E, "SUB_SAMPLE", 80)
    monkeypatch.setattr(E, "PART_ROWS", 50)
    made = []
    real = E._split
    monkeypatch.setattr(E, "_split", lambda placed, overlap: made.append(real(placed, overlap)) or made[-1])
    rows = cases()
    got = {r.vec_id: tuple(r)[1:] for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute(rows)
    assert set(got) == set(want) and sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values()) and all(got[i][0] <= want[i][0] for i in got)
    lists = [r.clusters for r in made[0].collect()]
    assert len({c for x in lists for c in x}) > 20 and all(len(set(x)) == len(x) <= 9 for x in lists)


def test_empty(spark):
    assert E.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert E.link(spark.createDataFrame([(4, None, None)], "vec_id long, embedding array<float>, label int")).first() == (4, 0, 4, True)


def test_recall_of_query(spark):
    from textquarry.llm.queries import QUERIES

    dir_ = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{dir_}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, got = brute(rows), {r.vec_id: tuple(r)[1:] for r in QUERIES["op4_pruned_graph"](spark, dir_).collect()}
    assert got == want
