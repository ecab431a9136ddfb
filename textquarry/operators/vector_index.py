"""Two indexes of vectors: cells with exact bounds, for joins of two growing tables, and quantised codes, for small scans.

A vector without direction (null, empty, zero, with null or non-finite components, or of another length than the index) is not
indexed and asks for nothing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import vector as V
from textquarry.plans.rounds import cut, drop

#: Rows that centroids and code tables are fitted on (those with the smallest hashes), and the most cells: they go to all tasks.
SAMPLE, MOST_CELLS = 20_000, 4_096
#: Vectors in a block and queries in a pack: what a task multiplies at a time.
BLOCK, PACK = 2_000, 500
#: Queries go to so many groups and vectors to so many slices, to more where one would have more than MEETING rows: each two meet in a task,
#: so either table is shuffled so many times. STEP queries are compared at a time.
GROUPS, MEETING, STEP = 8, 128_000, 1_000


def _unit(vectors: DataFrame, id_: str, vector: str, dim: int | None = None, as_: str = "id") -> DataFrame:
    """(as_, v): vectors of length one as little-endian doubles."""
    x = F.col(vector).cast("array<double>")
    whole = F.size(x) > 0 if dim is None else F.size(x) == dim
    sound = vectors.filter(x.isNotNull() & whole & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))).select(F.col(id_).alias(as_), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for i, row in enumerate(b.column(1)):
                v = np.asarray(row.values, np.float64)
                n = np.abs(v).max(initial=0.0)
                if n > 0:
                    v = v / n  # first by the largest component, so squares neither vanish nor overflow
                    keep.append(i)
                    out.append((v / np.sqrt(v @ v)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], [as_, "v"])

    return sound.mapInArrow(run, f"{as_} {dict(sound.dtypes)[as_]}, v binary")


def _sampled(units: DataFrame) -> np.ndarray:
    rows = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("v").to_pylist()
    return np.array([np.frombuffer(r, "<f8") for r in rows]) if rows else np.zeros((0, 0))


def _centroids(sample: np.ndarray, m: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = sample[np.sort(rng.choice(len(sample), m, replace=False))]
    for _ in range(rounds):
        near = (sample @ c.T - (c * c).sum(1) / 2).argmax(1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=m)
        np.add.at(sums, near, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _away(x: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The least distance from each row that a vector of each cell can have."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)) - radius - 1e-7


def _may_hold(away: np.ndarray, kth: np.ndarray, seen: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which cells can hold a vector nearer than the k-th so far, and were not seen."""
    reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(2 - 2 * kth, 0)) + 1e-7)
    may = away <= reach[:, None]
    for s in seen.T:
        may &= names[None] != s[:, None]
    return may


def _nearest(asks: pa.Table, blocks: pa.Table, cells: tuple, k: int) -> pa.Table:
    """The k nearest of each of `asks` in `blocks`. Scores are looked through with single precision; what may count is taken exactly."""
    centroids, radius, names = cells
    out: list[tuple] = []
    rows = pa.concat_arrays(blocks.column("rows").chunks) if blocks.num_rows and asks.num_rows else None
    if rows is not None:
        flat = rows.flatten()
        ids, dim = flat.field("id"), centroids.shape[1]
        begin = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())])
        nth = np.empty(len(ids), np.int64)
        nth[ids.to_pandas().argsort(kind="stable").to_numpy()] = np.arange(len(ids))  # ties go by id
        order = np.lexsort((nth, np.repeat(np.arange(len(rows)), np.diff(begin))))  # within each block
        v, nth, at = _matrix(flat.field("v"), dim)[order], nth[order], np.searchsorted(names, blocks.column("cell").to_numpy())
        small, some = v.astype(np.float32), np.unique(at)
        place = np.searchsorted(some, at)
        q, kth, seen = _matrix(asks.column("v"), dim), asks.column("kth").to_numpy().astype(float), np.stack(asks.column("seen").to_numpy())
        for lo in range(0, len(q), STEP):
            x = q[lo : lo + STEP]
            may = _may_hold(_away(x, centroids[some], radius[some]), kth[lo : lo + STEP], seen[lo : lo + STEP], names[some])
            bar, low = np.nan_to_num(kth[lo : lo + STEP], nan=-np.inf), x.astype(np.float32)
            held = new = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for b in range(len(rows)):
                who, mine = np.flatnonzero(may[:, place[b]]), slice(begin[b], begin[b + 1])
                if not len(who):
                    continue
                row, col = np.nonzero(low[who] @ small[mine].T >= (bar[who] - 1e-5)[:, None])
                if len(row) > 50_000:  # many: the best of each query in the block
                    s = np.round(x[who] @ v[mine].T, 12)
                    col = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(who)), col.shape[1])
                    score, col = np.take_along_axis(s, col, 1).ravel(), col.ravel()
                else:
                    score = np.round(np.einsum("ij,ij->i", x[who[row]], v[begin[b] + col]), 12)
                keep = score >= bar[who[row]]
                new = tuple(np.concatenate([h, n]) for h, n in zip(new, (who[row[keep]], begin[b] + col[keep], score[keep]), strict=True))
                if len(new[0]) > 20 * STEP or b == len(rows) - 1 or np.isneginf(bar[who]).any():
                    held = tuple(np.concatenate(h) for h in zip(held, new, strict=True))
                    new = tuple(h[:0] for h in new)
                    by = np.lexsort((nth[held[1]], -held[2], held[0]))
                    held = tuple(h[by] for h in held)
                    place_of = np.arange(len(by)) - np.searchsorted(held[0], held[0])
                    last = place_of == k - 1
                    bar[held[0][last]] = np.maximum(bar[held[0][last]], held[2][last])
                    held = tuple(h[place_of < k] for h in held)
            held = tuple(np.concatenate(h) for h in zip(held, new, strict=True))
            out.append((lo + held[0], held[1], held[2]))
    if not out:
        return pa.table({"query_id": asks.column("query_id").slice(0, 0), "id": pa.array([], blocks.schema.field("rows").type.value_type.field("id").type), "score": pa.array([], pa.float64())})
    row, col, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"query_id": asks.column("query_id").take(pa.array(row)), "id": ids.take(pa.array(order[col])), "score": score})


@dataclass
class CellIndex:
    """blocks: (cell, block, ids, matrix), at most about BLOCK vectors of a cell in each. cells: (cell, centroid, radius, blocks)."""

    blocks: DataFrame
    cells: DataFrame
    id_type: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_: str = "id", vector: str = "vector", cells: int | None = None) -> CellIndex:
        """Deal `vectors` to cells around centroids and write both to `path`; about sqrt(rows) cells, MOST_CELLS at most. The length of
        the first sampled vector is that of the index."""
        spark = vectors.sparkSession
        units = cut(_unit(vectors, id_, vector), "units")
        kind = dict(units.dtypes)["id"]
        sample = units.orderBy(F.xxhash64("id"), "id").limit(1).toArrow().column("v").to_pylist()
        dim = len(sample[0]) // 8 if sample else 1
        kept = units.filter(F.octet_length("v") == 8 * dim)
        n, rows = kept.count(), _sampled(kept)
        m = min(len(rows), MOST_CELLS, cells or max(1, round(n**0.5)))
        centroids = _centroids(rows, m) if m else np.zeros((0, dim))
        told = spark.sparkContext.broadcast(centroids)  # MOST_CELLS rows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = told.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f8").reshape(b.num_rows, -1)
                near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
                far = np.sqrt(((x - c[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int64()), pa.array(far)], ["id", "v", "cell", "far"])

        dealt = cut(kept.mapInArrow(run, f"id {kind}, v binary, cell long, far double"), "dealt")
        sizes = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
        placed = dealt.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        packed = placed.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))  # about BLOCK rows
        packed.write.mode("overwrite").parquet(f"{path}/blocks")
        known = spark.createDataFrame([(i, c.astype("<f8").tobytes()) for i, c in enumerate(centroids)], "cell long, centroid binary")
        known.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/cells")
        drop(units, dealt)
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        blocks = spark.read.parquet(f"{path}/blocks")
        return cls(blocks, spark.read.parquet(f"{path}/cells"), blocks.schema["rows"].dataType.elementType["id"].dataType.simpleString())

    def knn(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector", probe: int = 4, skip_self: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the k nearest vectors of every row of `queries` by cosine to 12 decimals, ties by id.

        A query visits the `probe` cells first that may hold the nearest vectors, and then all others that can hold one nearer than
        its k-th. These are many where vectors have little structure, so for them no visit is a row: groups of queries meet slices of
        blocks in tasks, which leave out the cells that a query need not see. Neither table is broadcast, and a cell with any share
        of the rows is spread over its blocks. skip_self: hits with the query's own id are left out. One row for each query id."""
        spark, want = queries.sparkSession, k + skip_self
        cells = sorted(self.cells.collect(), key=lambda r: r.cell)  # MOST_CELLS at most
        kind = dict(queries.dtypes)[query_id]
        if not cells:
            return spark.createDataFrame([], f"query_id {kind}, id {self.id_type}, score double, rank int")
        dim, slices = len(cells[0].centroid) // 8, max(GROUPS, -(-sum(r.blocks for r in cells) * BLOCK // MEETING))
        told = spark.sparkContext.broadcast((np.array([np.frombuffer(r.centroid, "<f8") for r in cells]), np.array([r.radius for r in cells]), np.array([r.cell for r in cells])))
        holds = np.zeros((len(cells), slices), bool)
        for at, r in enumerate(cells):
            holds[at, (r.cell + np.arange(min(r.blocks, slices))) % slices] = True
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, radius, names = told.value
            for b in batches:
                if b.num_rows:
                    order = np.argsort(_away(_matrix(b.column(1), dim), c, radius), axis=1, kind="stable")[:, :probe]
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(names[order]), pa.list_(pa.int64()))], ["query_id", "v", "seen"])

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, radius, names = told.value
            for b in batches:
                if b.num_rows:
                    may = _may_hold(_away(_matrix(b.column(1), dim), c, radius), b.column(3).to_numpy(zero_copy_only=False), np.stack(b.column(2).to_numpy(zero_copy_only=False)), names)
                    where = may.astype(np.float32) @ holds.astype(np.float32) > 0
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.flatnonzero(w) for w in where], pa.list_(pa.int64()))], ["query_id", "v", "seen", "kth", "slices"])

        units = cut(_unit(queries, query_id, vector, dim, "query_id").mapInArrow(first, f"query_id {kind}, v binary, seen array<long>"), "queries")
        hits = self._met(units.select("query_id", "v", F.explode("seen").alias("cell")), want, kind)
        best = cut(hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= want), "best")
        kth = best.filter(F.col("rank") == want).select("query_id", F.col("score").alias("kth"))
        asked = units.hint("merge").join(kth, "query_id", "left").select("query_id", "v", "seen", "kth")
        told_n = Observation()
        asked = cut(asked.mapInArrow(rest, f"query_id {kind}, v binary, seen array<long>, kth double, slices array<long>").filter(F.size("slices") > 0).observe(told_n, F.count("*").alias("n")), "asked")
        n = told_n.get["n"]
        if n:
            groups = max(-(-n // MEETING), min(GROUPS, -(-n // PACK)))
            deal = lambda df, c: df.groupBy("group", c)
            asks = asked.select("query_id", "v", "seen", "kth", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group"), F.explode("slices").alias("slice"))
            rows = self.blocks.withColumn("slice", F.pmod(F.col("cell") + F.col("block"), F.lit(slices))).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
            met = deal(asks, "slice").cogroup(deal(rows, "slice")).applyInArrow(lambda x, y: _nearest(x, y, told.value, want), f"query_id {kind}, id {self.id_type}, score double")
            held, best = best, cut(best.drop("rank").unionByName(met).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= want), "best")
            drop(held)
        drop(units, asked)
        return best.filter("id <> query_id").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k) if skip_self else best

    def _met(self, rows: DataFrame, k: int, kind: str) -> DataFrame:
        """(query_id, id, score): each visit's k best of each block of its cell."""
        n = rows.groupBy("cell").agg(F.ceil(F.count("*") / PACK).alias("packs")).join(self.cells.select("cell", "blocks"), "cell")
        packs = rows.join(F.broadcast(n), "cell").groupBy("cell", "blocks", F.pmod(F.xxhash64("query_id"), F.col("packs")).alias("pack")).agg(F.collect_list(F.struct("query_id", "v")).alias("asks"))
        each = packs.select("cell", "asks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        met = each.hint("merge").join(self.blocks, ["cell", "block"]).select("asks", "rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            side = lambda x: (x.values.field(0), np.frombuffer(b"".join(x.values.field(1).to_pylist()), "<f8"))
            for b in batches:
                for i in range(b.num_rows):
                    (asks, q), (ids, x) = side(b.column(0)[i]), side(b.column(1)[i])
                    q, x = q.reshape(len(asks), -1), x.reshape(len(ids), -1)
                    order = ids.to_pandas().argsort(kind="stable").to_numpy()  # ties go by id
                    s = np.round(q @ x[order].T, 12)  # beyond, equal vectors differ by the shape of the product
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(asks)), top.shape[1])
                    yield pa.RecordBatch.from_arrays([asks.take(pa.array(row)), ids.take(pa.array(order[top.ravel()])), pa.array(np.take_along_axis(s, top, 1).ravel())], ["query_id", "id", "score"])

        return met.mapInArrow(run, f"query_id {kind}, id {self.id_type}, score double")


@dataclass
class Quantised:
    """codes: (id, code), `bits` for each component of a vector of length one; levels: what a code stands for, by component."""

    codes: DataFrame
    levels: np.ndarray
    bits: int

    @classmethod
    def build(cls, vectors: DataFrame, bits: int = 4, id_: str = "id", vector: str = "vector") -> Quantised:
        """Fit 2^bits levels for each component on SAMPLE rows, by quantiles and then by means, and code all `vectors`."""
        if bits not in (2, 4):
            raise ValueError("codes have 2 or 4 bits")
        sample = _sampled(_unit(vectors, id_, vector).filter(F.octet_length("v") == F.lit(cls._length(vectors, id_, vector))))
        n = 1 << bits
        levels = np.quantile(sample, (np.arange(n) + 0.5) / n, axis=0).T if len(sample) else np.zeros((1, n))
        for _ in range(10 if len(sample) else 0):
            near = np.abs(sample[:, :, None] - levels[None]).argmin(2) if sample.size * n < 5e8 else np.stack([np.searchsorted((w[1:] + w[:-1]) / 2, c) for w, c in zip(levels, sample.T, strict=True)], 1)
            for j in range(len(levels)):
                sums, got = np.bincount(near[:, j], sample[:, j], n), np.bincount(near[:, j], minlength=n)
                levels[j] = np.sort(np.where(got > 0, sums / np.maximum(got, 1), levels[j]))
        made = cls(vectors.sparkSession.createDataFrame([], f"id {dict(vectors.dtypes)[id_]}, code binary"), levels, bits)
        return replace(made, codes=cut(made._coded(vectors, id_, vector), "codes"))

    @staticmethod
    def _length(vectors: DataFrame, id_: str, vector: str) -> int:
        first = _unit(vectors, id_, vector).orderBy(F.xxhash64("id"), "id").select("v").first()
        return len(first.v) if first else 8

    @property
    def bytes_a_vector(self) -> int:
        return -(-len(self.levels) * self.bits // 8)

    def _coded(self, vectors: DataFrame, id_: str, vector: str) -> DataFrame:
        """Codes by the nearest level, several to a byte, the first component lowest."""
        levels, bits, units = self.levels, self.bits, _unit(vectors, id_, vector, len(self.levels))
        per = 8 // bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f8").reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(levels)))
                code = np.zeros((b.num_rows, -(-len(levels) // per) * per), np.uint8)
                for j, w in enumerate(levels):
                    code[:, j] = np.searchsorted((w[1:] + w[:-1]) / 2, x[:, j])
                packed = sum(code[:, k::per] << (bits * k) for k in range(per)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "code"])

        return units.mapInArrow(run, f"id {dict(units.dtypes)['id']}, code binary")

    def add(self, vectors: DataFrame, id_: str = "id", vector: str = "vector") -> Quantised:
        """Rows replace those of the same id; the levels stay."""
        return replace(self, codes=self.remove(vectors.select(F.col(id_).alias("id"))).codes.unionByName(self._coded(vectors, id_, vector)))

    def remove(self, ids: DataFrame) -> Quantised:
        return replace(self, codes=self.codes.join(ids.select("id"), "id", "left_anti"))

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, widen: int = 10, id_: str = "id", vector: str = "vector", query_id: str = "query_id") -> DataFrame:
        """(query_id, id, score, rank): the k nearest of the widen * k best by their codes, in the order of their exact cosine with
        `vectors`. Queries are a stated set and go out in blocks; scores of codes are sums of look-ups by byte."""
        dim, bits, levels = len(self.levels), self.bits, self.levels
        per, found, kind = 8 // bits, None, dict(self.codes.dtypes)["id"]
        q_kind, wide = dict(queries.dtypes)[query_id], k * widen
        padded = np.zeros((-(-dim // per) * per, 1 << bits))
        padded[:dim] = levels
        held: list = []

        def scan(block: list) -> DataFrame:
            told = self.codes.sparkSession.sparkContext.broadcast(([r.query_id for r in block], np.array([np.frombuffer(r.v, "<f8") for r in block])))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, q = told.value
                codes_of = np.arange(256)
                tables = []  # for each query: of each byte of a code, what it adds to the score
                for v in q:
                    w = np.zeros(len(padded))
                    w[:dim] = v
                    tables.append(sum(padded[p::per][:, (codes_of >> (bits * p)) & ((1 << bits) - 1)] * w[p::per][:, None] for p in range(per)).astype(np.float32).ravel())
                for b in batches:
                    if not b.num_rows:
                        continue
                    code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(np.int64)
                    code += 256 * np.arange(code.shape[1])
                    for name, t in zip(names, tables, strict=True):
                        s = t[code].sum(1)
                        top = np.argpartition(-s, wide - 1)[:wide] if len(s) > wide else np.arange(len(s))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(top)), b.column(0).take(pa.array(top)), pa.array(s[top].astype(float))], ["query_id", "id", "near"])

            return self.codes.mapInArrow(run, f"query_id {q_kind}, id {kind}, near double")

        units = _unit(queries, query_id, vector, dim, "query_id")
        for r in units.toLocalIterator():
            held.append(r)
            if len(held) == PACK:
                part, held = scan(held), []
                found = part if found is None else found.unionByName(part)
        if held:
            part = scan(held)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.codes.sparkSession.createDataFrame([], f"query_id {q_kind}, id {kind}, score double, rank int")
        nearest = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        some = found.withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= wide)
        exact = some.join(vectors.select(F.col(id_).alias("id"), F.col(vector).alias("_v")), "id").join(queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("_q")), "query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return exact.select("query_id", "id", V.cosine("_v", "_q").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


__all__ = ["CellIndex", "Quantised"]
