import random

import numpy as np
from pyspark.sql import functions as F

from textquarry.llm import decontam as D


def brute(item, doc, least):
    """Greedy tiling by definition: mark a longest common unmarked run, again and again."""
    fi, fd, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        top = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and fi[i + n] and fd[j + n] and item[i + n] == doc[j + n] >= 0:
                    n += 1
                if (n, -i, -j) > (top[0], -top[1], -top[2]) and n:
                    top = (n, i, j)
        n, i, j = top
        if n < least:
            return covered
        for x in range(n):
            fi[i + x] = fd[j + x] = False
        covered += n


def test_rolling():
    ids = np.arange(50) % 7
    for k in (1, 2, 3, 5, 8, 13, 21):
        h = D.rolling(ids, k)
        assert len(h) == 50 - k + 1
        for a in range(len(h)):
            for b in range(len(h)):
                assert (h[a] == h[b]) == (ids[a : a + k] == ids[b : b + k]).all()


def test_tile_against_definition():
    rnd = random.Random(1)
    for _ in range(300):
        item = [rnd.randrange(rnd.choice((2, 30))) for _ in range(rnd.randrange(1, 40))]
        cut = rnd.randrange(len(item) + 1)
        doc = [rnd.randrange(30) for _ in range(rnd.randrange(6))] + item[cut:] + [-1] + item[:cut] + [rnd.randrange(30) for _ in range(rnd.randrange(6))]
        got, want = D.tile(item, doc, 4)[0], brute(item, doc, 4)
        assert abs(got - want) <= (0 if len(set(item)) > 20 else 3), (item, doc)  # equal lengths may be marked in another order


def test_match(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words[:24])
    docs = [
        (1, "Intro text. " + item.upper().replace(" ", ", ") + " end"), (2, " ".join(words[12:24] + ["x"] + words[:12])), (3, " ".join(words[:8])), (4, None), (5, ""),
        (6, "say hello world now"), (7, " ".join(words[i] for i in range(23, -1, -1))), (1, item), (8, ("filler " * 30_000) + item),
    ]
    bench = spark.createDataFrame([(0, item), (1, "hello world"), (2, None), (3, ""), (4, "...")], "item_id int, text string")
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, item_id int")
    for block in (20_000_000, 5):
        got = [(r.doc_id, [(m.item_id, round(m.coverage, 3)) for m in r.matches]) for r in D.match(df, bench, block_chars=block).collect()]
        assert sorted(got) == sorted([(1, [(0, 1.0)]), (2, [(0, 1.0)]), (3, []), (4, []), (5, []), (6, [(1, 1.0)]), (7, []), (1, [(0, 1.0)]), (8, [(0, 1.0)])])
    assert D.match(df, bench.limit(0)).filter(F.size("matches") > 0).count() == 0
    assert D.match(df.limit(0), bench).count() == 0


def test_query_against_brute_force(spark):
    from textquarry.llm.queries import QUERIES

    dir_ = "/root/testdata/sf0.01"
    bench = [(i, D.words(t)) for i, t in spark.read.parquet(f"{dir_}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op7_greedy_string_tiling"](spark, dir_).collect()}
    assert len(got) == len(docs)
    leaks = 0
    for doc_id, text in docs:
        joined = b" " + b" ".join(D.words(text)) + b" "
        whole = {i for i, w in bench if b" " + b" ".join(w) + b" " in joined}
        leaks += bool(whole)
        assert got[doc_id].n_items >= len(whole)
        if got[doc_id].contaminated and not whole:
            item = dict(bench)[got[doc_id].item_id]
            ids = {w: n for n, w in enumerate(item)}
            assert brute([ids[w] for w in item], [ids.get(w, -1) for w in D.words(text)], 4) >= len(item) / 2
    assert leaks
