import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.llm import jaccard_join as J
from textquarry.llm.shingles import shingle_sets


def plain_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    """(n_shingles, component) of each doc_id, by all pairs that share a shingle."""
    sets = [(i, plain_set(t, width)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for k, (i, s) in enumerate(sets):
        near = {}
        for g in s:
            for j in index.setdefault(g, []):
                near[j] = near.get(j, 0) + 1
            index[g].append(k)
        for j, common in near.items():
            if 100 * common >= percent * (len(s) + len(sets[j][1]) - common):
                a, b = root(i), root(sets[j][0])
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_shingle_hashes_tell_what_words_tell():
    texts = ["a b c d e", "A  b\tc\nd e", "b c d e a", "ab c", "a bc", "", None, "é ü Ä ö", "É ü Ä ö", "a b c", "x\x1cy z w v", " lead and trail ", "c"]
    got = [tuple(s.tolist()) for s in shingle_sets(pa.array(texts), 4, slice_bytes=9)]
    want = [plain_set(t, 4) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for g, w in zip(got, want, strict=True):
        for h, v in zip(got, want, strict=True):
            assert (g == h) == (w == v)


def cases():
    rnd = random.Random(4)
    rows, vocabulary = [], [f"w{i}" for i in range(3000)]
    for c in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((6, 30, 120, 200)))]
        for _ in range(rnd.choice((1, 3, 25))):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                w = w[: -rnd.randrange(1, 8)]
            rows.append(" ".join(w) if c % 2 else " ".join(w).upper())
    passage = " ".join(vocabulary[:60])
    rows += [passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(20)) for _ in range(40)]
    rows += ["a b c", "A b  c", "a b", "a", "a", None, "", "  ", None, "same text here now ok", "same text here now ok"] + ["x " * 30_000, "x " * 20_000]
    out = list(enumerate(rows))
    rnd.shuffle(out)
    return out + [(3, dict(out)[3])]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_against_brute_force(spark, width, percent):
    rows = cases()
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, n int, token string").repartition(5)
    assert sorted(tuple(r) for r in J.link(df, width, percent).collect()) == brute(rows, width, percent)


def test_empty(spark):
    assert J.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert J.link(spark.createDataFrame([(1, None)], "doc_id long, text string")).first() == (1, 0, 1)


def test_query_against_brute_force(spark):
    from textquarry.llm.queries import QUERIES

    dir_ = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, r.text) for r in rows], 4, 85)
    assert sorted(tuple(r) for r in QUERIES["op6_grouped_prefix_join"](spark, dir_).collect()) == want
    assert len({c for _, _, c in want}) < len(want) and np.mean([n for _, n, _ in want]) > 10


def test_signatures_never_understate_what_is_common(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(9)
    words = [f"v{i}" for i in range(9000)]
    rows = [(i, " ".join(rnd.sample(words, n))) for i, n in enumerate((3, 50, 900, 1020, 1030, 1040, 2040, 2060, 5000, 5100))]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    own = J.profiles(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, none)
    a, b = (own.select(*(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "sig"))) for x in "ab")
    sets = dict(rows)
    for r in a.join(b, F.col("doc_id_a") < F.col("doc_id_b")).select("doc_id_a", "doc_id_b", "n_a", "n_b", J.differing_bits(F.col("sig_a"), F.col("sig_b")).alias("d")).collect():
        common = len(set(sets[r.doc_id_a].split()) & set(sets[r.doc_id_b].split()))
        assert common <= (r.n_a + r.n_b - r.d) / 2
        if min(r.n_a, r.n_b) > 0.5 * max(r.n_a, r.n_b):
            assert r.d > 0


def placed_and_shared(spark, rows):
    """rows: (token, gid, n, at, components of its members)"""
    placed = [(g, g * 100 + i, c) for g, cs in {g: cs for _, g, _, _, cs in rows}.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(placed, "gid long, rep long, component long"), spark.createDataFrame([r[:4] for r in rows], "token long, gid long, n long, at int")


def test_buckets_within_one_component_cost_no_pairs(spark):
    n = 100_000
    placed = spark.range(n).select(F.col("id").alias("gid"), F.col("id").alias("rep"), F.lit(0).cast("long").alias("component"))
    shared = spark.range(n).select(F.lit(7).cast("long").alias("token"), F.col("id").alias("gid"), F.lit(100).cast("long").alias("n"), F.lit(0).alias("at"))
    began = time.time()
    assert J._across(placed, shared, 80).count() == 0
    other = spark.createDataFrame([(n, n, n)], placed.schema)
    one = spark.createDataFrame([(7, n, 101, 0)], shared.schema)
    assert J._across(placed.unionByName(other), shared.unionByName(one), 80).count() == n  # each may link with the one of another component
    assert time.time() - began < 60


def test_pairs_across_components(spark):
    rng = random.Random(8)
    sizes = {g: (rng.randrange(5, 30), rng.sample(range(6), rng.choice([1, 1, 1, 2]))) for g in range(60)}
    rows = [(t, g, n, rng.randrange(0, 4), cs) for t in range(5) for g, (n, cs) in sizes.items() if rng.random() < 0.5]
    want = set()
    for t, g, n, at, cs in rows:
        for u, h, m, to, ds in rows:
            need = -(-(n + m) * 80 // 180)
            if t == u and g != h and 100 * min(n, m) >= 80 * max(n, m) and min(n - at, m - to) >= need:
                want |= {frozenset((g * 100 + i, h * 100 + j)) for i, c in enumerate(cs) for j, d in enumerate(ds) if c != d}
    want |= {frozenset((g * 100, g * 100 + 1)) for g, cs in {r[1]: r[4] for r in rows}.items() if len(cs) == 2}
    got = [frozenset(r) for r in J._across(*placed_and_shared(spark, rows), 80).collect()]
    assert set(got) == want and len(got) == len(want)
