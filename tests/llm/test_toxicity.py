import random

import numpy as np
from pyspark.sql import functions as F

from textquarry.llm import toxicity as T


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        bad, low = rnd.random() < 0.25, rnd.random() < 0.3
        w = [rnd.choice("alpha beta gamma delta omega sigma kappa".split()) + str(rnd.randrange(40)) for _ in range(rnd.randrange(5, 60))]
        if bad:
            w += rnd.sample(["nasty", "vile", "rotten", "horrid" + str(i)], 2)
        if low or bad and rnd.random() < 0.5:
            w += ["spam", "click" + str(i)]
        rnd.shuffle(w)
        rows.append((i, " ".join(w), int(not (low or "spam" in w)), int(bad)))
    return rows


def test_chain_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows[:600]] + [(601, None, 1), (602, 1, None), (0, None, None), (5, 1, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    chain = T.train(docs, labels, T.default_categories())
    assert [x.name for x in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    got = {r.doc_id: r.toxicity for r in T.classify(docs, chain).collect()}
    held = rows[600:]
    assert np.mean([got[i].is_toxic == bool(x) for i, _, _, x in held]) > 0.95
    assert np.mean([got[i].is_low_quality == (q == 0) for i, _, q, _ in held]) > 0.95
    # the same sample, the same chain
    assert T.train(docs.repartition(7), labels.repartition(3), T.default_categories()) == chain
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "nasty vile " * 50_000, None)], "doc_id long, text string, toxicity string")
    assert [(r.doc_id, r.toxicity.is_toxic) for r in T.classify(odd, chain).orderBy("doc_id").collect()] == [(1, False), (2, False), (2, False), (3, True)]
    assert T.classify(odd.limit(0), chain).count() == 0


def test_held_out_labels_of_the_tables(spark):
    dir_ = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{dir_}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    chain = T.train(docs, labels.filter(~held), T.default_categories())
    truth = labels.filter(held).groupBy("doc_id").agg(F.max("toxic").alias("y")).dropna()
    hit = {(r.x, r.y): r["count"] for r in T.classify(docs.join(truth, "doc_id"), chain).groupBy(F.col("toxicity.is_toxic").alias("x"), "y").count().collect()}
    caught, missed, wrong, left = (hit.get(k, 0) for k in ((True, 1), (False, 1), (True, 0), (False, 0)))
    assert caught + missed > 30 and caught >= 0.8 * (caught + missed) and wrong <= 0.03 * (wrong + left), hit


def test_repeated_ids_are_chosen_alike(spark):
    rows = corpus(300)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    texts = [(i, t) for i, t, _, _ in rows] + [(i, "other words " + t[::-1]) for i, t, _, _ in rows[:100]]
    one = T.train(spark.createDataFrame(texts, "doc_id long, text string"), labels, T.default_categories())
    assert T.train(spark.createDataFrame(texts[::-1], "doc_id long, text string").repartition(5), labels, T.default_categories()) == one


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    chain = T.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), T.default_categories())
    assert not T.classify(docs, chain).first().toxicity.is_toxic


def test_query(spark):
    from textquarry.llm.queries import QUERIES

    dir_ = "/root/testdata/sf0.01"
    got = QUERIES["op5_classifier_chain"](spark, dir_)
    labels = spark.read.parquet(f"{dir_}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    hit = {(r.toxic, r.y): r["count"] for r in got.join(labels, "doc_id").groupBy("toxic", "y").count().collect()}
    assert hit.get((True, 1), 0) >= 0.8 * (hit.get((True, 1), 0) + hit.get((False, 1), 0))
    assert hit.get((True, 0), 0) <= 0.03 * hit[(False, 0)]
    assert got.count() == spark.read.parquet(f"{dir_}/documents.parquet").count()
