"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import drop, save

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCHES = "array<struct<item_id:long,coverage:double,tiles:int,longest:int>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased; every character beyond ASCII belongs to a word."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k ids, modulo 2**64: from those of half the length, so in log2(k) steps."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width, out, done = _BASE, 1, None, 0
        h = (ids.astype(np.uint64) + np.uint64(0x51ED)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        while True:
            if k & width:
                out = h[done : done + n].copy() if out is None else out * power + h[done : done + n]
                done += width
            if done == k:
                return out
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2


def tile(item: list[int], doc: list[int], least: int) -> tuple[int, int, int]:
    """Running Karp-Rabin greedy string tiling: (item tokens covered, tiles, longest tile).

    At search length s all unmarked windows of s item tokens are hashed, those of the document slid over them, and each
    hit verified and extended; the longest matches are marked first, what a mark occludes is taken up again at a
    smaller s. s falls from the longest match to `least`. A negative token matches nothing.
    """
    free_i, free_d = [x >= 0 for x in item], [x >= 0 for x in doc]
    covered = tiles = longest = 0
    s = max(least, min(len(item), len(doc), 20))
    item_ids, doc_ids = np.asarray(item, np.int64), np.asarray(doc, np.int64)
    while True:
        at = defaultdict(list)
        for i, h in enumerate(rolling(item_ids, s).tolist()):
            if all(free_i[i : i + s]):
                at[h].append(i)
        found, seen = [], set()
        for j, h in enumerate(rolling(doc_ids, s).tolist()):
            for i in at.get(h, ()):
                if (i - j, j) in seen or not all(free_d[j : j + s]) or item[i : i + s] != doc[j : j + s]:
                    continue
                n = s
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                    n += 1
                seen.update((i - j, j + x) for x in range(n - s + 1))
                found.append((n, i, j))
        top = max(found, default=(0,))[0]
        if top > 2 * s:
            s = top
            continue
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_i[i : i + n]) and all(free_d[j : j + n]):
                free_i[i : i + n] = [False] * n
                free_d[j : j + n] = [False] * n
                covered, tiles, longest = covered + n, tiles + 1, max(longest, n)
        if s > 2 * least:
            s //= 2
        elif s > least:
            s = least
        elif not found:
            return covered, tiles, longest


class Index:
    """The benchmark items of one block: vocabulary, tokens, and for each seed length the sorted seeds with their items."""

    def __init__(self, items: list[tuple[int, str | None]], least: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        seeds = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            self.items.append((item_id, ids))
            if ids:
                k = min(least, len(ids))
                for h in rolling(np.asarray(ids), k).tolist():
                    seeds[k][h].add(len(self.items) - 1)
        self.seeds = {k: (np.array(sorted(x), np.uint64), dict(x)) for k, x in seeds.items()}

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words(text)), np.int64)
        known = ids >= 0
        near = defaultdict(list)
        for k, (sorted_seeds, by_seed) in self.seeds.items():
            if len(ids) < k:
                continue
            run = np.cumsum(np.concatenate(([0], known)))
            whole = np.flatnonzero(run[k:] - run[:-k] == k)  # windows of known words only
            if not len(whole):
                continue
            h = rolling(ids, k)[whole]
            at = np.searchsorted(sorted_seeds, h)
            hit = sorted_seeds[np.minimum(at, len(sorted_seeds) - 1)] == h
            for i, x in zip(whole[hit].tolist(), h[hit].tolist(), strict=True):
                for item in by_seed[x]:
                    near[item].append((i, k))
        out = []
        for item, places in near.items():
            item_id, tokens = self.items[item]
            k = places[0][1]
            if k * len(places) < threshold * len(tokens):  # even apart from each other they cover too little
                continue
            doc, last = [], 0
            for i, _ in places:
                if doc and i > last:
                    doc.append(-1)
                doc.extend(ids[max(i, last) if doc else i : i + k].tolist())
                last = i + k
            covered, tiles, longest = tile(tokens, doc, k)
            if covered >= threshold * len(tokens):
                out.append((item_id, covered / len(tokens), tiles, longest))
        return sorted(out, key=lambda m: (-m[1], m[0]))


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if block and size + len(row[1] or "") > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1] or "")
    if block:
        yield block


def match(docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.5, block_chars: int = 20_000_000) -> DataFrame:
    """Add `matches` to every row of `docs`: the benchmark items of which at least `threshold` of the tokens are tiled
    by matches of at least `least` tokens, in any order, best coverage first.

    The benchmark is a stated query set: it goes to the tasks in blocks of at most `block_chars` characters, each of
    which looks at every document (seeds of `least` shared tokens first, tiling only where there are enough). An item
    shorter than `least` tokens must occur whole; an item without words, and a null or empty text, match nothing.
    Row-wise: no shuffle; repeated rows and all columns stay, but one named matches is replaced.
    """
    out, held, saved = docs.withColumn("matches", F.array().cast(MATCHES)), None, None
    for block in _blocks(benchmark, block_chars):
        if held is not None:  # one block's index at a time: what it has found is written before the next one goes out
            last, saved = saved, save(out, "matches")
            drop(last)
            held.unpersist()
            out = saved
        held = docs.sparkSession.sparkContext.broadcast(Index(block, least))
        more = _tiles_of(held, threshold)(F.col("text").cast("string"))
        out = out.withColumn("matches", more if saved is None else F.concat("matches", more))
    best_first = lambda a, b: F.when(a["coverage"] != b["coverage"], F.when(a["coverage"] > b["coverage"], -1).otherwise(1)).otherwise(F.when(a["item_id"] < b["item_id"], -1).otherwise(1))
    return out if saved is None else out.withColumn("matches", F.array_sort("matches", best_first))


def _tiles_of(index, threshold: float):
    names = ("item_id", "coverage", "tiles", "longest")

    @F.pandas_udf(MATCHES)
    def tiles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[dict(zip(names, m, strict=True)) for m in index.value.matches(t, threshold)] for t in part], dtype=object)

    return tiles
