"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import components, drop, save

#: Vectors that the centroids are fitted on at most (those whose hash is smallest), and centroids at most.
SAMPLE_ROWS, MAX_CENTROIDS = 20_000, 2_048
#: Where the first level's clusters would outgrow CLUSTER_ROWS, each is split by centroids of its own, fitted on about so many of
#: its vectors, and its vectors are dealt to them in parts of PART_ROWS.
SUB_SAMPLE, PART_ROWS = 4_000, 20_000
#: Vectors wanted in a cluster; a shard of more than SHARD_ROWS is dealt out by pairs of blocks.
CLUSTER_ROWS, SHARD_ROWS = 500, 3_000
DEGREE, CANDIDATES, RANDOM, BEAM, ALPHA = 24, 48, 12, 32, 1.2
#: The audit asks for the ids that AUDIT_MODULUS divides, and for all rows of labels that have SMALL_LABEL of them at most.
AUDIT_MODULUS, AUDIT_RECALL, SMALL_LABEL = 50, 0.98, 500
_LOG = logging.getLogger(__name__)


def _unit(batch: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where null, zero, or with null or non-finite components."""
    out = []
    for v in batch:
        x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        with np.errstate(over="ignore"):
            ok = x is not None and len(x) and np.isfinite(x).all() and (top := np.abs(x).max()) > 0
        if ok:
            x = x / top
            out.append(x / np.sqrt((x * x).sum()))
        else:
            out.append(None)
    return out


def prepare(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, g, unit) of the vectors that can link; g is a 128-bit hash of the unit vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(batch.column(2))
            ok = [i for i, u in enumerate(units) if u is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ok, pa.int64())), batch.column(1).take(pa.array(ok, pa.int64())), pa.array([len(units[i]) for i in ok], pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(units[i].tobytes()) for i in ok], pa.binary()), pa.array([units[i] for i in ok], pa.list_(pa.float64())),
                ],
                ["vec_id", "label", "dim", "g", "unit"],
            )

    return (
        vectors.filter("label is not null and embedding is not null and vec_id is not null")
        .select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("embedding"))
        .mapInArrow(run, "vec_id long, label string, dim int, g binary, unit array<double>")
    )


def fit_centroids(units: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows of the sample."""
    c = units[np.linspace(0, len(units) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (units @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, units)
        norm = np.sqrt((sums**2).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def robust_prune(units: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Out-edges (n x degree, -1 where fewer): from its nearest rows and a few random ones each node keeps the closest, drops
    what lies alpha times closer to that than to the node, and goes on."""
    n = len(units)
    edges = np.full((n, degree), -1, np.int64)
    if n < 2:
        return edges
    near, rnd = min(CANDIDATES, n - 1), np.random.default_rng(n)
    for a in range(0, n, 256):
        rows = np.arange(a, min(a + 256, n))
        sims = units[rows] @ units.T
        sims[np.arange(len(rows)), rows] = -2
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        cand = np.concatenate([cand, rnd.integers(0, n, (len(rows), RANDOM))], 1)
        mine = np.take_along_axis(sims, cand, 1)  # a row itself has -2 and comes last
        order = np.argsort(-mine, axis=1, kind="stable")
        cand, mine = np.take_along_axis(cand, order, 1), np.take_along_axis(mine, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * mine, 0))
        v = units[cand]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("icd,ied->ice", v, v), 0))
        alive = (cand != rows[:, None]) & (mine > -2)
        for k in range(degree):
            some = alive.any(1)
            pick = alive.argmax(1)
            edges[rows[some], k] = cand[some, pick[some]]
            alive &= alpha * between[np.arange(len(rows)), pick] > far
            alive[np.arange(len(rows)), pick] = False
    return edges


def range_search(units: np.ndarray, begin: np.ndarray, to: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the nodes with cosine >= least that greedy search finds from the medoid. Node i's neighbours are
    to[begin[i]:begin[i+1]].

    Each step expands a query's best unexpanded node while that is among its `beam` best, and all unexpanded nodes in
    range, so a search goes on for as long as the range grows. All queries of a chunk step together."""
    n = len(units)
    medoid = int((units @ units.mean(0)).argmax())
    size = np.diff(begin)
    found_q, found_n = [], []
    for a in range(0, len(queries), 128):
        q = queries[a : a + 128]
        sim = np.full((len(q), n), -2.0)
        todo = np.zeros((len(q), n), bool)
        sim[:, medoid], todo[:, medoid] = units[q] @ units[medoid], True
        kth = min(beam, n) - 1
        while True:
            waiting = np.where(todo, sim, -3.0)
            best = waiting.argmax(1)
            value = waiting[np.arange(len(q)), best]
            bar = -np.partition(-sim, kth, axis=1)[:, kth]
            expand = todo & (sim >= least)
            go = np.flatnonzero((value > -3) & (value >= bar))
            expand[go, best[go]] = True
            who, node = np.nonzero(expand)
            if not len(who):
                break
            todo[who, node] = False
            ends = np.cumsum(size[node])
            for x, y in _parts(ends, 500_000):
                k = size[node[x:y]]
                at = np.arange(k.sum()) + np.repeat(begin[node[x:y]] - np.concatenate(([0], np.cumsum(k)[:-1])), k)
                key = np.unique(np.repeat(who[x:y], k) * n + to[at])
                w, t = key // n, key % n
                fresh = sim[w, t] < -1.5
                w, t = w[fresh], t[fresh]
                for b in range(0, len(w), 20_000):
                    sim[w[b : b + 20_000], t[b : b + 20_000]] = np.einsum("ij,ij->i", units[q[w[b : b + 20_000]]], units[t[b : b + 20_000]])
                todo[w, t] = True
        i, node = np.nonzero(sim >= least)
        found_q.append(q[i])
        found_n.append(node)
    return np.concatenate(found_q), np.concatenate(found_n)


def all_pairs(units: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of all rows with cosine >= least, by blocks of rows."""
    found = [(k + a, b) for k in range(0, len(units), 512) for a, b in (np.nonzero(units[k : k + 512] @ units.T >= least),)]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _parts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive parts of about `most` by running sums."""
    x = 0
    while x < len(ends):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + most, side="right")))
        yield x, y
        x = y


def _assign(reps: DataFrame, centroids: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """Add `clusters`: the `overlap` nearest centroids of the vector's dimension, ascending."""
    held = reps.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def nearest(units: pd.Series) -> pd.Series:
        out = [None] * len(units)
        dims = units.map(len).to_numpy()
        for d in np.unique(dims):
            at, c = np.flatnonzero(dims == d), held.value[int(d)]
            k = min(overlap, len(c))
            top = np.sort(np.argpartition(-(np.stack(units.to_numpy()[at]) @ c.T), k - 1, axis=1)[:, :k], axis=1)
            for i, t in zip(at, top, strict=True):
                out[i] = t.tolist()
        return pd.Series(out)

    return reps.withColumn("clusters", nearest("unit"))


def _split(placed: DataFrame, overlap: int) -> DataFrame:
    """`clusters` of a second level: in each of its clusters a vector goes to the `overlap` nearest centroids of that one.

    Centroids are fitted in tasks, on a bounded sample of each cluster, and meet their cluster's vectors part by part, so
    neither the driver nor a broadcast holds what grows with the number of vectors."""
    rows = placed.withColumn("cluster", F.explode("clusters"))
    sizes = save(rows.groupBy("dim", "cluster").agg(F.count("*").alias("size")), "sizes")
    sized = rows.join(sizes, ["dim", "cluster"])
    near = F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1 << 30)) < F.lit(float(SUB_SAMPLE) * (1 << 30)) / F.col("size")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep")
        units = np.stack(part["unit"].to_numpy())
        k = min(len(units), max(1, round(int(part["size"].iloc[0]) / CLUSTER_ROWS)))
        return pd.DataFrame({"dim": part["dim"].iloc[0], "cluster": part["cluster"].iloc[0], "centroids": [fit_centroids(units, k).ravel()]})

    fitted = sized.filter(near).select("dim", "cluster", "size", "rep", "unit").groupBy("dim", "cluster").applyInPandas(fit, "dim int, cluster int, centroids array<double>")
    fitted = save(fitted, "centroids")
    parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    known = sizes.join(fitted, ["dim", "cluster"], "left").select(F.col("dim").alias("d"), F.col("cluster").alias("c"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"), "centroids")
    dealt = sized.select("dim", "cluster", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), "rep", "unit")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"rep": [], "own": []})
        first = int(left["cluster"].iloc[0]) << 32
        flat = right["centroids"].iloc[0]
        if flat is None:  # the sample had none of a small cluster
            return pd.DataFrame({"rep": left["rep"], "own": [[first]] * len(left)})
        units, c = np.stack(left["unit"].to_numpy()), np.asarray(flat).reshape(-1, int(left["dim"].iloc[0]))
        k = min(overlap, len(c))
        top = np.concatenate([np.argpartition(-(units[a : a + 1024] @ c.T), k - 1, axis=1)[:, :k] for a in range(0, len(units), 1024)])
        return pd.DataFrame({"rep": left["rep"], "own": list(first + top.astype(np.int64))})

    own = dealt.groupBy("dim", "cluster", "part").cogroup(known.groupBy("d", "c", "p")).applyInPandas(nearest, "rep long, own array<long>")
    lists = own.groupBy("rep").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("clusters"))  # overlap * overlap at most
    return placed.drop("clusters").join(lists, "rep")


_CELL = ["label", "dim", "cluster", "i", "j"]


def _cells(reps: DataFrame) -> DataFrame:
    """A row for each shard of a vector; of shards beyond SHARD_ROWS, for each pair of blocks that its block is in."""
    rows = reps.withColumn("cluster", F.explode("clusters"))
    blocks = rows.groupBy("label", "dim", "cluster").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["label", "dim", "cluster"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _links(reps: DataFrame, least: float, exact: bool = False) -> DataFrame:
    """(label, dim, rep, n, root): for each vector and cell how many others it links with there (copies counted), and the
    smallest vector of the cell that its links reach. `exact` compares all pairs of a cell instead of searching a graph."""
    cells = save(_cells(reps), "cells")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        units, ids = np.stack(rows["unit"].to_numpy()), rows["rep"].to_numpy()
        edges = robust_prune(units)
        i, k = np.nonzero(edges >= 0)
        to = edges[i, k]
        # of the edges that come in, each node also goes back along its nearest ones
        near = np.einsum("ij,ij->i", units[i], units[to])
        order = np.lexsort((-near, to))
        first = np.searchsorted(to[order], to[order])
        back = order[np.arange(len(order)) - first < DEGREE]
        return pd.DataFrame({"src": np.concatenate([ids[i], ids[to[back]]]), "dst": np.concatenate([ids[to], ids[i[back]]])})

    graph = cells.filter(F.lit(not exact)).select(*_CELL, "rep", "unit").groupBy(*_CELL).applyInPandas(build, "src long, dst long")
    lists = graph.groupBy(F.col("src").alias("rep")).agg(F.collect_set("dst").alias("near"))  # a degree's edges from each cell

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        units, ids, m = np.stack(rows["unit"].to_numpy()), rows["rep"].to_numpy(), rows["m"].to_numpy()
        lists = []
        for near in rows["near"]:
            near = np.zeros(0, np.int64) if near is None else np.asarray(near)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            lists.append(at[ids[at] == near])
        begin = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        if exact:
            a, b = all_pairs(units, least)
        else:
            a, b = range_search(units, begin, np.concatenate(lists), np.arange(len(rows)), least)
        # Links are symmetric: what either search has found counts for both.
        n = len(rows)
        key = np.unique(np.concatenate([a * n + b, b * n + a]))
        a, b = key // n, key % n
        block, cluster, i, j = rows["block"].to_numpy(), int(rows["cluster"][0]), int(rows["i"][0]), int(rows["j"][0])
        ok = (a != b) & ((block[a] != block[b]) | (i == j))  # a pair of one block belongs to the cell of that block alone
        a, b = a[ok], b[ok]
        # A pair that shares several clusters belongs to the smallest of them.
        lists = np.full((n, max(map(len, rows["clusters"]))), -1, np.int64)
        for k, c in enumerate(rows["clusters"]):
            lists[k, : len(c)] = c
        owned = np.ones(len(a), bool)
        for s in range(lists.shape[1]):
            for t in range(lists.shape[1]):
                x = lists[a, s]
                owned &= ~((x == lists[b, t]) & (x >= 0) & (x < cluster))
        a, b = a[owned], b[owned]
        root = np.arange(n)
        while len(a):
            new = root.copy()
            np.minimum.at(new, a, root[b])
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"label": rows["label"], "dim": rows["dim"], "rep": ids, "n": np.bincount(a, m[b], n).astype(np.int64), "root": ids[root]})

    found = cells.join(lists, "rep", "left").groupBy(*_CELL).applyInPandas(search, "label string, dim int, rep long, n long, root long")
    out = save(found.filter("n > 0"), "found")
    drop(cells)
    return out


def audit(reps: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(label, dim, true, got): links of the audited vectors by brute force over all rows of their label, and those found.

    The stated queries go out in blocks beside hash blocks of all vectors, so no group is gathered whole."""
    count = reps.groupBy("label", "dim").agg(F.count("*").alias("rows"), F.count(F.when(F.col("rep") % AUDIT_MODULUS == 0, 1)).alias("asked"))
    asked = F.when(F.col("rows") <= SMALL_LABEL, F.col("rows")).otherwise(F.col("asked"))
    sizes = count.select("label", "dim", (F.col("rows") <= SMALL_LABEL).alias("small"), F.ceil(F.col("rows") / 20_000).cast("int").alias("parts"), F.ceil(asked / 2_000).cast("int").alias("groups"))
    queries = reps.join(sizes, ["label", "dim"]).filter(F.col("small") | (F.col("rep") % AUDIT_MODULUS == 0))
    nth = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 20))
    asked = queries.select("label", "dim", (nth % F.col("groups")).alias("group"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.struct("rep", "unit").alias("q"))
    rows = reps.join(sizes.filter("groups > 0"), ["label", "dim"]).select(
        "label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1)).alias("group"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.struct("rep", "m", "unit").alias("r")
    )

    def brute(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"label": [], "dim": [], "rep": [], "n": []})
        q, qi = np.stack([x["unit"] for x in left["q"]]), np.array([x["rep"] for x in left["q"]])
        r, ri, m = np.stack([x["unit"] for x in right["r"]]), np.array([x["rep"] for x in right["r"]]), np.array([x["m"] for x in right["r"]])
        n = ((q @ r.T >= least) & (qi[:, None] != ri[None])) @ m
        return pd.DataFrame({"label": left["label"], "dim": left["dim"], "rep": qi, "n": n.astype(np.int64)})

    rows = rows.select(*(F.col(c).alias(f"r_{c}") for c in ("label", "dim", "group", "part")), "r")
    true = asked.groupBy("label", "dim", "group", "part").cogroup(rows.groupBy("r_label", "r_dim", "r_group", "r_part")).applyInPandas(brute, "label string, dim int, rep long, n long")
    true = true.groupBy("label", "dim", "rep").agg(F.sum("n").alias("true"))
    got = found.groupBy("rep").agg(F.sum("n").alias("got"))
    return true.join(got, "rep", "left").groupBy("label", "dim").agg(F.sum("true").alias("true"), F.sum(F.coalesce("got", F.lit(0))).alias("got"))


def link(vectors: DataFrame, least: float = 0.93, overlap: int = 3) -> DataFrame:
    """One row for each vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label (not null) and one dimension link where their cosine in double precision is at least `least`;
    null, zero and non-finite vectors, and null labels, link with nothing. Equal unit vectors collapse into one node
    that counts for all its copies. Nodes go to their `overlap` nearest centroids (fitted on SAMPLE_ROWS vectors at
    most; every vector is indexed), and where MAX_CENTROIDS are too few for the number of vectors, within each cluster to
    its own ones, so that clusters keep their size; each shard is built into a robust-pruned graph, the shards' adjacency lists are
    united, and every node's range search starts from the medoid. The audit always compares with brute force, label by
    label, for a fixed fiftieth of the ids and all rows of small labels; labels below AUDIT_RECALL go again with twice
    the overlap, and where that reaches all centroids, exactly, in blocks. Recall is logged. Rows that repeat a vec_id count as one vector
    with several values. component_id is the smallest vec_id that links reach; kept says that it is the row's own.
    """
    ready = save(prepare(vectors), "vectors")
    reps = ready.groupBy("label", "dim", "g").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("m"), F.any_value("unit").alias("unit"))
    reps = save(reps, "reps")
    total = reps.count()
    sample = reps.select("rep", "unit").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).toPandas()["unit"]
    by_dim: dict[int, list] = {}
    for u in sample:
        by_dim.setdefault(len(u), []).append(u)
    dims = [r.dim for r in reps.select("dim").distinct().collect()]  # a few
    share = {d: len(by_dim.get(d, ())) / max(len(sample), 1) for d in dims}
    centroids = {d: fit_centroids(np.stack(by_dim[d]), min(len(by_dim[d]), MAX_CENTROIDS, max(1, round(total * share[d] / CLUSTER_ROWS)))) if d in by_dim else np.eye(1, d) for d in dims}
    most = max((len(c) for c in centroids.values()), default=1)
    found, pending, wide = None, reps, total > 2 * CLUSTER_ROWS * MAX_CENTROIDS
    while True:
        placed = _assign(pending, centroids, overlap)
        got = _links(save(_split(placed, overlap), "placed") if wide else placed, least)
        told = save(audit(pending, got, least), "audit")
        sums = told.agg(F.coalesce(F.sum("true"), F.lit(0)).alias("true"), F.coalesce(F.sum("got"), F.lit(0)).alias("got")).first()
        _LOG.info("overlap %d: %d of %d audited links found", overlap, sums.got, sums.true)
        poor = save(told.filter(F.col("got") < AUDIT_RECALL * F.col("true")).select("label", "dim"), "poor")
        some = bool(poor.head(1))
        good = got.join(poor, ["label", "dim"], "left_anti") if some else got
        found = good if found is None else found.unionByName(good)
        if not some:
            break
        pending = save(pending.join(poor, ["label", "dim"], "left_semi"), "pending")
        overlap *= 2
        if overlap >= 2 * most:  # all centroids were tried: what is left is compared pair by pair
            found = found.unionByName(_links(pending.withColumn("clusters", F.array(F.lit(0))), least, exact=True))
            break
    member = ready.join(reps.drop("unit"), ["label", "dim", "g"]).select("vec_id", "rep", "m")
    edges = found.filter("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    of = components(edges.unionByName(member.filter("vec_id <> rep").select(F.col("vec_id").alias("src"), F.col("rep").alias("dst"))))
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    counted = member.join(n, "rep", "left").groupBy("vec_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = vectors.select(F.col("vec_id").cast("long")).join(counted, "vec_id", "left").join(of, F.col("vec_id") == F.col("node"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
