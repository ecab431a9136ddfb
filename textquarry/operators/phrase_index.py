"""A positional index of trigrams, so that phrase search reads the postings of a few trigrams instead of all texts.

Tables in a versioned store: `postings`, bucketed by gram; `docs` (id, segment, grams, importance), bucketed by id; `grams` (gram,
rows), bucketed by gram. Postings are kept in blocks: a task takes nodes of some millions of characters at a time, and a row holds all
places of a gram in them, as differences of variable length; store.read("postings") gives them as (gram, id, field, segment,
positions). Each batch of upserts is a segment whose postings are put beside the others; a posting counts while `docs` names its
segment for its id, so an upsert or delete rewrites only the buckets of `docs` it touches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.sources.versioned import Store, Transaction

FIELDS = ("title", "body", "tags")
_SHIFT = 21  # bits of a code point; three of them are one long
#: A block holds the nodes of so many characters; a longer node is a block of its own.
BLOCK_CHARS = 2_000_000
_IDS = -1  # in place of a gram: the row with the ids of a block's nodes, in their order
_BLOCK = "gram long, segment string, block long, n int, texts binary, counts binary, gaps binary, ids array<string>"
_NO_IDS = "gram long, segment string, block long, nth int, field int, positions array<int>"


def gram_of(three: str) -> int:
    a, b, c = map(ord, three)
    return a << 2 * _SHIFT | b << _SHIFT | c


def _texts(nodes: DataFrame, fields: tuple[str, ...]) -> list:
    kinds = dict(nodes.dtypes)
    return [F.coalesce(F.array_join(c, ",") if kinds[c].startswith("array") else F.col(c), F.lit("")) for c in fields]


def _varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of 7 bits each, the lowest first, and where each one begins (and the end)."""
    bits = int(values.max(initial=0)).bit_length()
    if bits <= 7:
        return values.astype(np.uint8), np.arange(len(values) + 1)
    v = values.astype(np.uint32 if bits <= 32 else np.uint64)
    size = np.ones(len(v), np.int8)
    for k in range(7, bits, 7):
        size += v >> k > 0
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]] = (v & 127).astype(np.uint8) | (size > 1).astype(np.uint8) << 7
    some = np.arange(0)
    for k in range(1, -(-bits // 7)):
        some = np.flatnonzero(size > k) if k == 1 else some[size[some] > k]
        out[at[some] + k] = (v[some] >> 7 * k & 127).astype(np.uint8) | (size[some] > k + 1).astype(np.uint8) << 7
    return out, at


def _numbers(column: pa.Array) -> np.ndarray:
    """All numbers of a column of _varint() bytes, one row after the other."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    nth = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * nth, starts)


def _since(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before, the value itself at `starts`."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The inverse of _since()."""
    total = np.cumsum(values)
    return total - np.repeat(total[starts] - values[starts], np.diff(np.append(starts, len(values))))


def _packed(gram: np.ndarray, text: np.ndarray, counts: np.ndarray, positions: np.ndarray, segment: str, block: int) -> pa.RecordBatch:
    """Rows of a block: of postings in the order of gram and text, each of so many of the positions."""
    rows = np.flatnonzero(np.diff(gram, prepend=-2))
    first = np.cumsum(counts) - counts
    at = np.append(rows, len(gram))

    def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        data, begin = _varint(values)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(begin[ends].astype(np.int32)), pa.py_buffer(data)])

    columns = [
        pa.array(gram[rows], pa.int64()), pa.array([segment] * len(rows), pa.string()), pa.array(np.full(len(rows), block), pa.int64()), pa.array(np.diff(at), pa.int32()),
        binary(_since(text, rows), at), binary(counts, at), binary(_since(positions, first), np.append(first[rows], len(positions))), pa.nulls(len(rows), pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["gram", "segment", "block", "n", "texts", "counts", "gaps", "ids"])


def _ids_row(ids: list[str], segment: str, block: int) -> pa.RecordBatch:
    columns = [pa.array([_IDS], pa.int64()), pa.array([segment]), pa.array([block], pa.int64()), pa.array([0], pa.int32()), *(pa.array([b""]) for _ in range(3)), pa.array([ids], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["gram", "segment", "block", "n", "texts", "counts", "gaps", "ids"])


def _order(c: np.ndarray, gram: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The stable order of `gram`, which begins at `whole` in the code points c; of few kinds it is that of 16-bit numbers."""
    used = np.flatnonzero(np.bincount(c)) if len(c) else c
    if len(used) > 400:
        return np.argsort(gram, kind="stable")
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
    number[used] = np.arange(len(used))
    n = number[c]
    dense = ((n[:-2] * len(used) + n[1:-1]) * len(used) + n[2:])[whole]
    rank = np.cumsum(np.bincount(dense) > 0) - 1
    if not len(rank) or rank[-1] >= 1 << 16:
        return np.argsort(gram, kind="stable")
    return np.argsort(rank.astype(np.uint16)[dense], kind="stable")


def _block(ids: list[str], texts: list[str], segment: str, block: int) -> Iterator[pa.RecordBatch]:
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    whole = np.flatnonzero(of[:-2] == of[2:])
    gram = (c[:-2] << 2 * _SHIFT | c[1:-1] << _SHIFT | c[2:])[whole]
    order = _order(c, gram, whole)
    gram, place = gram[order], whole[order]
    text = of[place]
    first = np.flatnonzero((np.diff(gram, prepend=-2) != 0) | (np.diff(text, prepend=-1) != 0))
    yield _packed(gram[first], text[first], np.diff(np.append(first, len(gram))), place - (np.cumsum(size) - size)[text], segment, block)
    yield _ids_row(ids, segment, block)


def blocks_of(nodes: DataFrame, segment: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The postings of the lower-cased texts of `nodes` in blocks, numbered by their task, so that a task which is run again makes the
    same ones. Nodes have to come in an order that can be repeated, as they do from files."""
    most = BLOCK_CHARS  # as it is here, not where tasks run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        ids: list[str] = []
        texts: list[str] = []
        for batch in batches:
            for i, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = sum(map(len, own))
                if ids and size + n > most:
                    yield from _block(ids, texts, segment, block)
                    block, size, ids, texts = block + 1, 0, [], []
                ids.append(i)
                texts += own
                size += n
        if ids:
            yield from _block(ids, texts, segment, block)

    return nodes.select("id", *(F.lower(t).alias(f"text{i}") for i, t in enumerate(_texts(nodes, fields)))).mapInArrow(run, _BLOCK)


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, text, count) of each posting of some rows, and the positions of all."""
    n = b.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    starts = (np.cumsum(n) - n)[n > 0]
    counts = _numbers(b.column("counts"))
    return row, _summed(_numbers(b.column("texts")), starts), counts, _summed(_numbers(b.column("gaps")), np.cumsum(counts) - counts)


def _opened(blocks: DataFrame, fields: int) -> DataFrame:
    """(gram, segment, block, nth, field, positions): positions are code points from 0, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                row, text, counts, positions = _unpacked(b)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(positions, pa.int32()))
                take = pa.array(row)
                columns = [*(b.column(c).take(take) for c in ("gram", "segment", "block")), pa.array(text // fields, pa.int32()), pa.array(text % fields, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "segment", "block", "nth", "field", "positions"])

    return blocks.filter(F.col("gram") != _IDS).drop("ids").mapInArrow(run, _NO_IDS)


def _ids_of(blocks: DataFrame) -> DataFrame:
    """(segment, block, nth, id) of all nodes of the blocks."""
    return blocks.filter(F.col("gram") == _IDS).select("segment", "block", F.posexplode("ids").alias("nth", "id"))


class _Blocks(Store):
    """A store whose `postings` are read as rows of their own."""

    fields = len(FIELDS)

    def blocks(self, keys: list[int] | None = None, version: int | None = None) -> DataFrame:
        return super().read("postings", version, None if keys is None else [*keys, _IDS])

    def read(self, table: str, version: int | None = None, keys: list | None = None) -> DataFrame:
        if table != "postings":
            return super().read(table, version, keys)
        blocks = self.blocks(keys, version)
        return _opened(blocks, self.fields).join(_ids_of(blocks), ["segment", "block", "nth"]).select("gram", "id", "field", "segment", "positions")


def _docs_of(nodes: DataFrame, segment: str, fields: tuple[str, ...]) -> DataFrame:
    grams = reduce(lambda a, b: a + b, (F.greatest(F.length(t) - 2, F.lit(0)) for t in _texts(nodes, fields)))
    return nodes.select("id", F.lit(segment).alias("segment"), grams.cast("long").alias("grams"), "importance")


def cover(counts: dict[int, int], phrase: str) -> list[int]:
    """Offsets of trigrams that together cover every character of `phrase`, with the least postings in all."""
    best: list[tuple[int, list[int]]] = [(0, [])] + [(-1, [])] * len(phrase)  # best[n]: of the first n characters
    for end in range(3, len(phrase) + 1):
        n = counts.get(gram_of(phrase[end - 3 : end]), 0)
        before = [best[k] for k in range(end - 3, end) if best[k][0] >= 0]
        if before:
            cost, at = min(before)
            best[end] = (cost + n, [*at, end - 3])
    return best[len(phrase)][1]


class PhraseIndex:
    """The index of a table of nodes (id, title, body, tags, importance) in a folder."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS):
        self.spark, self.store, self.fields = spark, _Blocks(spark, path), fields
        self.store.fields = len(fields)

    @classmethod
    def build(cls, nodes: DataFrame, path: str, fields: tuple[str, ...] = FIELDS, buckets: int = 64) -> PhraseIndex:
        """Index all `nodes`; one row for each id."""
        made = cls(nodes.sparkSession, path, fields)
        made.store.run(lambda t: made._fill(t, nodes, buckets))
        return made

    def _fill(self, t: Transaction, nodes: DataFrame, buckets: int) -> None:
        segment = uuid.uuid4().hex
        t.write("postings", blocks_of(nodes, segment, self.fields), "gram", buckets)
        t.write("docs", _docs_of(nodes, segment, self.fields), "id", buckets)
        t.write("grams", self._counted(t.read("postings")), "gram", buckets)

    @staticmethod
    def _counted(blocks: DataFrame) -> DataFrame:
        return blocks.filter(F.col("gram") != _IDS).groupBy("gram").agg(F.sum("n").alias("rows"))

    def upsert(self, nodes: DataFrame) -> int:
        """Index new or changed nodes, one row for each id; earlier postings of theirs no longer count. Returns the version."""
        segment = uuid.uuid4().hex

        def put(t: Transaction) -> None:
            t.append("grams", self._counted(t.append("postings", blocks_of(nodes, segment, self.fields))))
            t.merge("docs", _docs_of(nodes, segment, self.fields), lambda old, fresh: old.join(fresh.select("id"), "id", "left_anti").select(old.columns).unionByName(fresh))

        return self.store.run(put)

    def delete(self, ids: DataFrame) -> int:
        """Without the nodes of these ids (id)."""
        return self.store.run(lambda t: t.merge("docs", ids.select("id").distinct(), lambda old, gone: old.join(gone, "id", "left_anti")))

    def compact(self) -> int:
        """Rewrite the postings without those that no longer count."""

        fields = len(self.fields)

        def kept(key: tuple, block: pa.Table, live: pa.Table) -> pa.Table:
            """A block (of BLOCK_CHARS) without the nodes that are not in `live`."""
            ids, rows = block.filter(pc.equal(block["gram"], _IDS)), block.filter(pc.not_equal(block["gram"], _IDS))
            if not live.num_rows:
                return block.slice(0, 0)
            if not rows.num_rows:
                return ids
            b = rows.combine_chunks().sort_by("gram").to_batches()[0]
            row, text, counts, positions = _unpacked(b)
            keep = np.isin(text // fields, live["nth"].to_numpy())
            out = _packed(b.column("gram").to_numpy()[row[keep]], text[keep], counts[keep], positions[np.repeat(keep, counts)], key[0].as_py(), key[1].as_py())
            return pa.concat_tables([pa.Table.from_batches([out]), ids])

        def rewrite(t: Transaction) -> None:
            blocks, entry = t.read("postings"), t.entry("postings")
            live = _ids_of(blocks).join(t.read("docs").select("id", "segment"), ["id", "segment"], "left_semi").select(F.col("segment").alias("of"), F.col("block").alias("at"), "nth")
            t.write("postings", blocks.groupBy("segment", "block").cogroup(live.groupBy("of", "at")).applyInArrow(kept, _BLOCK), "gram", entry["buckets"])
            t.write("grams", self._counted(t.read("postings")), "gram", entry["buckets"])

        return self.store.run(rewrite)

    def occurrences(self, phrase: str) -> DataFrame:
        """(id, tf) of nodes in whose fields `phrase` occurs, in any case, overlaps counted: where the trigrams of a cover of the
        phrase stand at the right distances. Only the buckets of these trigrams are read."""
        low = phrase.lower()
        docs = self.store.read("docs").select("id", "segment")
        grams = sorted({gram_of(low[i : i + 3]) for i in range(len(low) - 2)})
        if not grams:
            return docs.select("id", F.lit(0).cast("long").alias("tf")).limit(0)
        counts = {r.gram: r.n for r in self.store.read("grams", keys=grams).groupBy("gram").agg(F.sum("rows").alias("n")).collect()}
        if len(counts) < len(grams):  # one of them occurs nowhere
            return docs.select("id", F.lit(0).cast("long").alias("tf")).limit(0)
        at = cover(counts, low)
        blocks = self.store.blocks(sorted({gram_of(low[i : i + 3]) for i in at}))
        rows = _opened(blocks, len(self.fields))
        found = None
        for i in sorted(at, key=lambda i: counts[gram_of(low[i : i + 3])]):  # the rarest first
            one = rows.filter(F.col("gram") == gram_of(low[i : i + 3])).select("segment", "block", "nth", "field", F.expr(f"transform(positions, p -> p - {i})").alias(f"at_{i}"))
            if found is None:
                found = one.withColumnRenamed(f"at_{i}", "at")
            else:
                found = found.join(one, ["segment", "block", "nth", "field"]).select("segment", "block", "nth", "field", F.array_intersect("at", f"at_{i}").alias("at")).filter(F.size("at") > 0)
        return found.join(_ids_of(blocks), ["segment", "block", "nth"]).join(docs, ["id", "segment"]).groupBy("id").agg(F.sum(F.size("at")).cast("long").alias("tf"))

    def search(self, phrase: str, k: int | None = None) -> DataFrame:
        """(id, bm25, importance) as search.bm25_search() ranks them: by bm25 (lower is better), importance, id."""
        docs = self.store.read("docs")
        tf = self.occurrences(phrase)
        total = docs.agg(F.count("*").alias("_n"), F.avg("grams").alias("_avg"))
        hits = tf.join(docs.select("id", "grams", "importance"), "id")
        stats = hits.agg(F.count("*").alias("_m")).join(F.broadcast(total))  # one row
        idf = F.log((F.col("_n") - F.col("_m") + 0.5) / (F.col("_m") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = -idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("grams") / F.col("_avg")))
        ranked = hits.join(F.broadcast(stats)).select("id", score.alias("bm25"), "importance").orderBy("bm25", F.desc("importance"), "id")
        return ranked if k is None else ranked.limit(k)


__all__ = ["PhraseIndex", "blocks_of", "cover", "gram_of"]
