import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from textquarry.llm import mixing as M

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Target of each source, round by round with exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: Fraction(rest * w[s], sum(w[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s] if s in full else share[s]) for s in names}
        full |= above


def documents(seed=1, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", "", None, "tiny", "漢"]
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(rng.choice([0, 1, 3, 40, 200]))), rng.choices(sources, [30, 5, 5, 5, 2, 2, 0, 1])[0]) for i in range(n)]
    rows += [(n, "only three words", "tiny"), (n + 1, None, "nothing"), (None, "a null id", "a"), (7, "again again", "a"), (7, "again again", "a"), (7, None, "a"), (8, "\t \n", "b")]
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("block,per_shard", [(16, 8), (7, 1), (256, 256)])
def test_mix(spark, block, per_shard):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    mix = M.plan(df, block, per_shard, text=True)
    got = M.report(mix).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.size, r.source, r.source_size) for r in got) == Counter((i, len(words(t)), s, sizes[s]) for i, t, s in rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-12) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)  # to the word

    # Slots are full, hold their block's own words in order, and no block comes again before all came.
    texts = defaultdict(set)
    for i, t, s in rows:
        texts[i, s].add(tuple(words(t)))
    slots, seen = defaultdict(list), Counter()
    for p in M.pieces(mix).collect():
        assert any(tuple(p.words) == t[p.start : p.start + p.length] for t in texts[p.doc_id, None if p.src == "1" else p.src[1:]]) and len(p.words) == p.length
        slots[p.shard, p.slot].append(p)
        seen[p.src, p.epoch, p.block] += p.offset == 0
    assert max(seen.values()) == 1
    known = {(s.shard, s.slot): s for s in mix.slots.collect()}
    assert slots.keys() == known.keys()
    for k, ps in slots.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == known[k].length <= block
    shards = Counter(s for s, _ in known)
    assert sorted(shards) == list(range(len(shards))) and all(n == per_shard for s, n in shards.items() if s < len(shards) - 1)
    assert all(sorted(b for a, b in known if a == s) == list(range(n)) for s, n in shards.items())


def test_reruns_and_other_partitions_agree(spark):
    rows = documents(2)
    a, b = (sorted(M.report(M.plan(spark.createDataFrame(rows, SCHEMA).repartition(n), 16, 8)).collect(), key=str) for n in (1, 7))
    assert a == b
    assert a != sorted(M.report(M.plan(spark.createDataFrame(rows, SCHEMA), 16, 8, seed=2)).collect(), key=str)


def test_shards_are_multinomial_draws(spark):
    rows = [(i, " ".join(["x"] * 40), s) for i, s in enumerate("ab" * 1500)]
    mix = M.plan(spark.createDataFrame(rows, SCHEMA), 10, 50, weights=(1, 3))
    counts = np.array([r["count"] for r in mix.slots.filter("src = '0b'").groupBy("shard").count().collect()])
    assert len(counts) == 240 and counts.sum() == 9000
    assert counts.mean() == 37.5 and 0.7 < counts.var() / (50 * 0.75 * 0.25) < 1.4  # of a binomial, not of fixed shares


def test_many_sources_are_joined(spark, monkeypatch):
    rows = [(i, "w " * (i % 17), f"s{i % 300}") for i in range(1200)]
    want = sorted(M.report(M.plan(spark.createDataFrame(rows, SCHEMA), 4, 16)).collect(), key=str)
    monkeypatch.setattr(M, "TOLD_SOURCES", 10)
    monkeypatch.setattr(M, "INTERVALS", 5)
    monkeypatch.setattr(M, "SHARDS", 2)
    monkeypatch.setattr(M, "PARTS", 65_536)
    got = M.report(M.plan(spark.createDataFrame(rows, SCHEMA), 4, 16)).collect()
    assert sorted(got, key=str) == want
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    assert all(r.target == pytest.approx(target[r.source], rel=1e-12) for r in got)


def test_permutations():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 4097]:
        for key in rng.integers(-(1 << 62), 1 << 62, 3):
            x = M.permute_each(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(x.tolist()) == list(range(n))
    big = (1 << 40) + 1
    assert (M.permute_each(np.arange(big - 1000, big), np.full(1000, big), np.zeros(1000, np.int64)) < big).all()


def test_empty_tables_long_texts_and_writing(spark, tmp_path):
    assert M.report(M.plan(spark.createDataFrame([], SCHEMA))).collect() == []
    assert sorted(tuple(r) for r in M.report(M.plan(spark.createDataFrame([(1, None, None), (2, " ", None)], SCHEMA))).collect()) == [(i, 0, None, 0, 0.0, 0) for i in (1, 2)]
    df = spark.createDataFrame([(1, "w " * 500_000, "a", 5, "x"), (2, "v " * 100, "b", 6, "y")], SCHEMA + ", size int, src string")
    mix = M.plan(df, text=True)
    M.write(mix, str(tmp_path / "mix"))
    out = spark.read.parquet(str(tmp_path / "mix")).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in out} == {1: 499_800, 2: 300}
