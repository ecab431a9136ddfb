"""Phrases that occur often and more often than their parts suggest, mined by pivot partitioning.

Every occurrence of a phrase is owned by its rarest word, the pivot. A task cuts each text, around each of its words, to the
neighbours that are more common (no other phrase could have that word as its pivot), adds up equal fragments, and routes
them by pivot. All fragments of a pivot meet, so each phrase is counted and thrown out in one place, and only frequent ones
leave it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import arrow_rows, bit_table, drop, may_hold, save
from textquarry.llm.shingles import mix

#: The words whose exact counts are told to the tasks (16 bytes each): the most common ones. Words beyond them count as
#: rarer than all of them, in the order of their hashes. The order only decides who owns a phrase, never its count.
KNOWN_WORDS = 1_000_000
#: Bytes of one language's texts that a task works on at a time; all languages together at most four times as many.
SLICE = 8 << 20
#: Words of text for each bucket of pivots, and bytes of fragments that are counted at once: a word takes two bytes at
#: least, so there are fewer than 2^21 different ones and three of them fit 63 bits. A bucket with more is counted in
#: parts that go on unfiltered, and are added up afterwards.
BUCKET_WORDS, BLOCK = 65_536, 4 << 20
BITS = 21
#: Parts of a language (and of the rows that one word joins) that are sorted apart first.
PARTS, WORD_PARTS = 64, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_NOTHING, _BLANK = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")


def _words(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in them, piece of each word) of a slice of text."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[a] if len(a) else np.zeros(0, np.int32)
    offsets = np.concatenate(([0], np.cumsum(b - a))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), piece


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of a task's documents (lang, text), many at a time, cut where a piece ends."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def cut(lang: str) -> Iterator[tuple[str, bytes]]:
        data, at = b"\n".join(held.pop(lang)), 0
        sizes.pop(lang)
        while at < len(data):
            end = _END.search(data, at + SLICE)
            end = end.start() if end else len(data)
            yield lang, data[at:end]
            at = end

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            held.setdefault(lang, []).append(text.as_py())
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 1
            if sizes[lang] >= SLICE:
                yield from cut(lang)
        if sum(sizes.values()) >= 4 * SLICE:
            for lang in list(held):
                yield from cut(lang)
    for lang in list(held):
        yield from cut(lang)


def word_counts(docs: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, n) of words that occur `min_count` times in a language; the row with no word has the count of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _slices(batches):
            words, ids, _ = _words(data)
            n = np.append(np.bincount(ids, minlength=len(words)), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.concat_arrays([words, pa.nulls(1, words.type)]).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | F.col("word").isNull())


def _fragments(ids: np.ndarray, piece: np.ndarray, rank: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pivot's word place, first word place, pivot's place within, words) of each fragment of two words or more: around a word,
    up to `reach` words on the left that are more common, and on the right that are as common or more. Of a word that repeats
    in a phrase the first one owns it, so each occurrence of a phrase has one owner. rank: of each word, -1 for infrequent ones."""
    n, order = len(ids), np.where(rank < 0, np.iinfo(np.int32).max, rank)[ids]
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for k in range(1, reach + 1):
        if n > k:
            near = piece[k:] == piece[:-k]
            left[k:] += near & (left[k:] == k - 1) & (order[:-k] < order[k:])
            right[:-k] += near & (right[:-k] == k - 1) & (order[k:] <= order[:-k])
    at = np.flatnonzero((left + right > 0) & (order < np.iinfo(np.int32).max))
    return at, at - left[at], left[at].astype(np.uint8), (left[at] + right[at] + 1).astype(np.int64)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first, count) of equal rows of `columns`. Rows that only share a hash stay apart, so one may be told twice."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    own = first[inverse]
    same = np.logical_and.reduce([c == c[own] for c in columns])
    other = np.flatnonzero(~same)
    return np.concatenate((first, other)), np.concatenate((np.bincount(inverse[same], minlength=len(first)), np.ones(len(other), np.int64)))


def routed(docs: DataFrame, words: DataFrame, max_words: int, buckets: int) -> DataFrame:
    """(lang, bucket, payload): the fragments of each task's slices by bucket of pivots. A payload holds their number, each
    one's pivot place, each one's count, and their words, compressed."""
    keyed = words.filter("word is not null").select(F.xxhash64("lang", "word").alias("h"), "n")
    top = keyed.orderBy(F.desc("n"), "h").limit(KNOWN_WORDS).toArrow()
    hashes, counts = top.column("h").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(hashes)
    # KNOWN_WORDS pairs, and at most 32 MB of bits that rule out most infrequent words.
    told = docs.sparkSession.sparkContext.broadcast((hashes[order], counts[order], bit_table(keyed, "h", keyed.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, bits = told.value
        small = zstandard.ZstdCompressor(level=3).compress
        for lang, data in _slices(batches):
            vocabulary, ids, piece = _words(data)
            if not len(ids):
                continue
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            h = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer(), seed) for w in vocabulary), np.uint64, len(vocabulary))
            place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            n = np.where(known[place] == h, number[place], 0) if len(known) else np.zeros(len(h), np.int64)
            rank = np.empty(len(h), np.int32)
            rank[np.lexsort((h, -n))] = np.arange(len(h), dtype=np.int32)
            rank[~may_hold(bits, h)] = -1
            pivot, start, within, size = _fragments(ids, piece, rank, max_words - 1)
            if not len(pivot):
                continue
            padded = np.concatenate((ids, np.zeros(2 * max_words, ids.dtype)))
            first, count = _distinct([within, *(np.where(k < size, padded[start + k] + 1, 0) for k in range(2 * max_words - 1))])
            bucket = (h[ids[pivot[first]]] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, first, count = bucket[by], first[by], count[by].astype("<i8")
            start, size, within = start[first], size[first], within[first]
            ends = np.cumsum(size)
            text = pc.binary_join_element_wise(vocabulary, _NOTHING, _BLANK).take(pa.array(ids[np.repeat(start - ends + size, size) + np.arange(ends[-1])]))
            at = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
            raw = np.frombuffer(text.buffers()[2], np.uint8).copy()
            raw[at[ends] - 1] = 0x0A
            edges = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
            of, payloads = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                of.append(int(bucket[a]))
                payloads.append(small(np.int64(b - a).tobytes() + within[a:b].tobytes() + count[a:b].tobytes() + raw[at[ends[a] - size[a]] : at[ends[b - 1]]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), pa.array(of, pa.int64()), pa.array(payloads, pa.binary())], ["lang", "bucket", "payload"])

    return docs.mapInArrow(run, "lang string, bucket long, payload binary")


def _mined(within: np.ndarray, count: np.ndarray, data: bytes, max_words: int, at_least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(phrase, its words, its count) of the phrases around the pivots of fragments that occur `at_least` times in them."""
    vocabulary, ids, piece = _words(data)
    first = np.searchsorted(piece, np.arange(len(within)))
    length = np.diff(np.append(first, len(ids)))
    pivot, keys, weights = first + within, [], []
    number = np.append(ids.astype(np.int64) + 1, np.zeros(max_words, np.int64))
    for size in range(2, max_words + 1):
        for before in range(size):
            f = np.flatnonzero((within >= before) & (within + size - before <= length))
            key = np.zeros(len(f), np.int64)
            for k in range(max_words):
                key = key << BITS | (number[pivot[f] - before + k] if k < size else 0)
            keys.append(key)
            weights.append(count[f])
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(weight, starts) if len(starts) else np.zeros(0, np.int64)
    key, n = key[starts][n >= at_least], n[n >= at_least]
    part = [(key >> BITS * (max_words - 1 - k)) & ((1 << BITS) - 1) for k in range(max_words)]
    columns = [vocabulary.take(pa.array(p - 1, mask=p == 0)) for p in part]
    return pc.binary_join_element_wise(*columns, _BLANK, null_handling="skip"), sum((p > 0).astype(np.int64) for p in part), n


def mine(fragments: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """(lang, phrase, words, a) of phrases that occur `min_count` times, counted bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        key, whole, held, size = None, True, [], 0

        def counted(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, whole
            if held:
                phrase, words, n = _mined(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), b"".join(h[2] for h in held), max_words, min_count if last and whole else 1)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(n), pa.string()), phrase.cast(pa.string()), pa.array(words, pa.int64()), pa.array(n, pa.int64())], ["lang", "phrase", "words", "a"])
            held, size, whole = [], 0, last

        for batch in batches:
            for lang, bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (lang, bucket) != key:
                    yield from counted(True)
                    key = (lang, bucket)
                raw = unpack(payload.as_buffer())
                m = int(np.frombuffer(raw, "<i8", 1)[0])
                text = raw[8 + 9 * m :]
                if size and size + len(text) > BLOCK:
                    yield from counted(False)
                held.append((np.frombuffer(raw, np.uint8, m, 8), np.frombuffer(raw, "<i8", m, 8 + m), text))
                size += len(text)
        yield from counted(True)

    near = fragments.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    counted = near.mapInArrow(run, "lang string, phrase string, words long, a long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Add l, r and score of the lowest-scoring cut: floor(1000000 * a * a / (l * r)), ties to the earliest cut. Decimals hold
    it exactly for counts of up to 10^16."""
    parts = F.split("phrase", " ")
    at = lambda a, n: F.array_join(F.slice(parts, a, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int"))).alias("k")).select(
        "lang", "phrase", "a", "words", "k", at(F.lit(1), F.col("k")).alias("left"), at(F.col("k") + 1, (F.col("words") - F.col("k")).cast("int")).alias("right")
    )
    # A common word is part of very many phrases: such rows go by parts, and words are copied to all of them.
    salt = F.when(F.instr("part", " ") > 0, 0).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(WORD_PARTS)).cast("int"))
    known = words.filter("word is not null").select("lang", F.col("word").alias("part"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(WORD_PARTS - 1))).alias("salt"))
    known = known.unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.lit(0).alias("salt")))
    sides = cuts.select("lang", "phrase", "a", "words", "k", F.posexplode(F.array("left", "right")).alias("side", "part")).withColumn("salt", salt)
    found = sides.hint("merge").join(known, ["lang", "part", "salt"])
    each = found.groupBy("lang", "phrase", "a", "words", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    each = each.select("*", (exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)").alias("_num"), (exact("l") * exact("r")).cast("decimal(38,0)").alias("_den"))
    best = each.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct(F.expr("_num div _den").cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "words", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, candidates: DataFrame, cover: int) -> DataFrame:
    """The rows of `phrases` whose words no longer candidate contains that has `cover` percent of their count or more."""
    parts = F.split("phrase", " ")
    longer = candidates.filter("words > 2").select(
        "lang", "a", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), (F.col("words") - 1).cast("int")), lambda i: F.array_join(F.slice(parts, i, F.lit(2)), " ")))).alias("phrase")
    )
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return phrases.hint("merge").join(most, ["lang", "phrase"], "left").filter(F.coalesce(F.col("most") * 100 < F.col("a") * cover, F.lit(True))).drop("most")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (A-Z lower-cased) are cut at `[.,;:!?` and line ends into pieces and those at blanks into words; phrases are 2 to
    `max_words` (2 or 3) words of a piece, candidates those with a count of a >= `min_count`, overlaps included. l and r are
    the counts of the two parts of the cut with the lowest score, n counts all words of the language. Candidates that a longer
    one covers by `cover` percent go. The order is score and a descending, then the phrase by bytes.

    A null lang counts as `und`; null and empty texts hold no words. Rows that repeat a doc_id count each, doc_id is not
    read, other columns are ignored. A long text is worked on in slices that end with a piece (one piece without end has to
    fit a task). An empty table has no rows.
    """
    if max_words not in (2, 3):
        raise ValueError("phrases have two or three words at most")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with arrow_rows(docs.sparkSession, 1_000):
        words = save(word_counts(texts, min_count), "words")
    total = words.filter("word is null").agg(F.sum("n")).first()[0] or 0
    with arrow_rows(docs.sparkSession, 1_000):
        phrases = save(mine(routed(texts, words, max_words, total // BUCKET_WORDS + 1), max_words, min_count), "phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so no task sorts more than one part of its candidates.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    few = uncovered(scored(phrases, words), phrases, cover).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    all_words = words.filter("word is null").select("lang", "n")
    out = save(ranked.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop(words, phrases)
    return out


__all__ = ["collocations", "mine", "routed", "scored", "uncovered", "word_counts"]
