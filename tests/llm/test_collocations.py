import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from textquarry.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words=3, min_count=10, cover=50, top=2000):
    count, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f = count.setdefault(lang, Counter())
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in candidates.items():
            if len(p) == 2 and any(p in (q[:2], q[1:]) and 100 * b >= cover * a for q, b in candidates.items() if len(q) == 3):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["a", "b", "C", "dé", "漢", "e", "ff", "\x00", "x1"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    for i in range(n):
        body = "".join(w + rng.choices([" ", "\t ", ", ", ".", "\n", "\x0c"], [20, 2, 2, 1, 1, 1])[0] for w in rng.choices(words, weights, k=rng.randrange(60)))
        yield i, body, rng.choice(["en", "en", "fr", None, "und", ""])
    yield from [(None, None, None), (3, "", "en"), (3, "a a a a a a a a a a a a a a", "rep"), (3, "a a a a a a a a a a a a a a", "rep"), (4, " \t.,;", "x")]


def got(df, **k):
    return sorted(tuple(r) for r in C.collocations(df, **k).collect())


@pytest.mark.parametrize("known,block,bucket", [(1_000_000, 4 << 20, 65_536), (5, 4 << 20, 50), (0, 200, 65_536), (20, 1, 1000)])
def test_against_brute_force(spark, monkeypatch, known, block, bucket):
    monkeypatch.setattr(C, "KNOWN_WORDS", known)
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "BUCKET_WORDS", bucket)
    rows = list(texts(1500))
    want = brute(rows)
    assert len(want) > 300
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6)) == want


def test_small_slices_two_words_and_few_ranks(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 300)
    rows = list(texts(600, 2))
    assert got(spark.createDataFrame(rows, SCHEMA), max_words=2, min_count=3, cover=80, top=7) == brute(rows, 2, 3, 80, 7)
    with pytest.raises(ValueError):
        C.collocations(spark.createDataFrame(rows, SCHEMA), max_words=4)


def test_an_owner_for_each_occurrence(spark):
    """Every occurrence of a phrase lies around exactly one pivot, whatever the order of words."""
    rng = random.Random(5)
    import numpy as np

    for _ in range(300):
        ids = np.array(rng.choices(range(4), k=rng.randrange(1, 12)), np.int32)
        piece = np.sort(np.array(rng.choices(range(3), k=len(ids)), np.int32))
        rank = np.array(rng.sample([0, 1, 2, -1], 4), np.int32)
        seen = Counter()
        for _, first, within, size in zip(*(x.tolist() for x in C._fragments(ids, piece, rank, 2)), strict=True):
            for k in (2, 3):
                for i in range(max(0, within - k + 1), min(within, size - k) + 1):
                    seen[first + i, k] += 1
        want = {(i, k) for k in (2, 3) for i in range(len(ids) - k + 1) if len(set(piece[i : i + k])) == 1 and all(rank[ids[i : i + k]] >= 0)}
        assert seen == dict.fromkeys(want, 1)


def test_rows_that_share_a_hash_stay_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(C, "mix", lambda x: x & np.uint64(1))
    a = np.array([1, 1, 2, 3, 2, 1])
    first, n = C._distinct([a, a * 2])
    sums = Counter()
    for i, k in zip(first.tolist(), n.tolist(), strict=True):
        sums[int(a[i])] += k
    assert sums == {1: 3, 2: 2, 3: 1}


def test_scores_beyond_64_bits(spark):
    big = 10**13 + 7
    phrases = spark.createDataFrame([("en", "x y", 2, big - 3)], "lang string, phrase string, words long, a long")
    words = spark.createDataFrame([("en", "x", big), ("en", "y", big - 1), ("en", None, big * 9)], "lang string, word string, n long")
    r = C.scored(phrases, words).first()
    assert (r.l, r.r, r.score) == (big, big - 1, 1_000_000 * (big - 3) ** 2 // (big * (big - 1)))


def test_hash_of_words_is_that_of_tasks(spark):
    for lang, word in (("en", "word"), ("", "é" * 40), ("und", "漢")):
        want = spark.range(1).select(F.xxhash64(F.lit(lang), F.lit(word))).first()[0]
        assert xxhash.xxh64_intdigest(word.encode(), xxhash.xxh64_intdigest(lang.encode(), 42)) == want % 2**64


def test_empty_tables_long_texts_and_other_columns(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, None), (2, ".", "en")], SCHEMA)) == []
    df = spark.createDataFrame([(1, "Red car, " * 400_000, "en", 5, "x")], SCHEMA + ", n int, phrase string")
    assert got(df) == [("en", 1, "red car", 400_000, 400_000, 400_000, 800_000, 1_000_000)]
