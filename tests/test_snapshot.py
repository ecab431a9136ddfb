import random

from pyspark.sql import functions as F

from textquarry.operators import snapshot
from textquarry.plans import queries
from textquarry.plans.rounds import cut_by, drop, numbered


def test_a_bucket_is_one_file(spark):
    """And not one for each task that has rows of it."""
    got = cut_by(spark.range(0, 1000, 1, 8), "rows", "id")
    assert len(got.inputFiles()) == 4 and got.count() == 1000
    drop(got)


def test_numbers_follow_the_order_without_a_second_shuffle(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").cast("string").alias("id"))
    got = numbered(df, ["k", "id"], "nth")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" not in plan.split("BroadcastExchange")[0] and "Window" not in plan.split("BroadcastExchange")[0]
    assert sorted((r.k, r.nth) for r in got.collect()) == [(i, i) for i in range(5000)]
    assert numbered(df.limit(0), ["k", "id"], "nth").count() == 0


def test_components_in_rounds_and_in_one_task(spark, monkeypatch):
    """A chain of 400 nodes in their order, one in none, a hub, loops and edges that are there twice; a few rounds in any case."""
    rng = random.Random(5)
    mixed = rng.sample(range(400, 600), 200)
    pairs = [(i, i + 1) for i in range(399)] + list(zip(mixed, mixed[1:])) + [(600, i) for i in range(601, 700)] + [(700, 700), (601, 600), (601, 600)]
    pairs += [(rng.randrange(710, 900), rng.randrange(710, 900)) for _ in range(90)]
    parent = list(range(900))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(str(i), i) for i in range(900)], "id string, pos long")
    edges = spark.createDataFrame([(str(a), str(b), 1.0) for a, b in pairs], "source string, target string, weight double")
    rounds, cut = [], snapshot.cut
    monkeypatch.setattr(snapshot, "cut", lambda df, what: rounds.append(what) or cut(df, what))
    for last in (60, 500_000):
        monkeypatch.setattr(snapshot, "LAST_EDGES", last)
        rounds.clear()
        s = snapshot.Snapshot.build(nodes, edges, "pos")
        assert {r.idx: r.component for r in s.components().collect()} == {i: root(i) for i in range(900)}
        assert rounds.count("left") <= 20 and (last < 1000 or not rounds.count("left"))
        s.drop()


def test_lines_are_summed_once_for_page_rank(spark, monkeypatch):
    asked, supplies = [], queries.supplies
    monkeypatch.setattr(queries, "supplies", lambda *a: asked.append(a) or supplies(*a))
    ranks = queries.page_rank(spark, "/root/testdata/sf0.001").agg(F.round(F.sum("rank"), 4).alias("s")).first()
    assert len(asked) == 1 and ranks.s == 1
