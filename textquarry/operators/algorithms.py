"""Graph algorithms over (source, target, weight) tables as joins and aggregates in rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textquarry.operators.snapshot import Snapshot, edge_cost
from textquarry.plans.rounds import cut, drop, numbered

#: Link prediction deals nodes to blocks of about so many neighbours in all, and adds up so many summands at a time.
HUB_ROWS, PAIRS = 16_000_000, 1_000_000
#: A task tells the neighbours of about so many edges apart.
EDGE_ROWS = 500_000


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    return edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids.withColumnRenamed("_id", "_t"), F.col("target") == F.col("_t"), "left_semi")


def _of_snapshot(s: Snapshot, df: DataFrame, what: str) -> DataFrame:
    """`df` with ids for numbers, on its own; the snapshot is deleted."""
    out = cut(df, what)
    s.drop()
    return out


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank), adding up to 1. Weighted shares; nodes without weight out spread theirs evenly; stops when a round moves
    less than `tolerance` in sum. For several algorithms over one graph build a Snapshot once."""
    s = Snapshot.build(nodes, edges)
    return _of_snapshot(s, s.pagerank(damping, rounds, tolerance).join(s.ids, "idx").select("id", "rank"), "ranks")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected edges reach."""
    s = Snapshot.build(nodes, edges)
    return _of_snapshot(s, s.named(s.components().withColumnRenamed("idx", "id"), "id", "component").select("id", "component"), "components")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10, order: str = "pos") -> DataFrame:
    """(id, label): asynchronous propagation in the order of `order`: each node takes the label with most weight among its
    neighbours, the one of the earliest node among equals, until nothing changes."""
    s = Snapshot.build(nodes, edges, order)
    return _of_snapshot(s, s.named(s.label_propagation(rounds).withColumnRenamed("idx", "id"), "id", "label").select("id", "label"), "labels")


def distances(edges: DataFrame, source: str, nodes: DataFrame | None = None) -> DataFrame:
    """(id, dist, prev) of all nodes that directed edges reach. Each round relaxes only nodes that have just improved."""
    spark = edges.sparkSession
    e = edges if nodes is None else with_ends(nodes, edges)
    costs = cut(e.select("source", "target", edge_cost(F.col("weight")).alias("cost")).filter("cost is not null").groupBy("source", "target").agg(F.min("cost").alias("cost")), "costs")
    best = active = spark.createDataFrame([(source, 0.0, None)], "id string, dist double, prev string")
    if nodes is not None and not nodes.filter(F.col("id") == source).head(1):
        return best.limit(0)
    while True:
        offers = active.join(costs, active.id == costs.source).select(F.col("target").alias("id"), (F.col("dist") + F.col("cost")).alias("d"), F.col("source").alias("p"))
        offers = offers.groupBy("id").agg(F.min(F.struct("d", "p")).alias("o"))
        better = offers.join(best, "id", "left").filter("dist is null or o.d < dist - 1e-15").select("id", F.col("o.d").alias("dist"), F.col("o.p").alias("prev"))
        held, active = active, cut(better, "active")
        drop(held)
        if not active.head(1):
            return best
        held, best = best, cut(best.join(active.select("id"), "id", "left_anti").unionByName(active), "best")
        drop(held)


def shortest_path(edges: DataFrame, source: str, target: str, nodes: DataFrame | None = None) -> list[str] | None:
    """The nodes on the way, None where there is none; [source] for itself. Ancestors by doubling: after k rounds those
    within 2**k steps of the target are known, so a path of n nodes takes log2(n) rounds."""
    tree = distances(edges, source, nodes)
    if not tree.filter(F.col("id") == target).head(1):
        return None
    far = cut(tree.filter("prev is not null").select("id", F.col("prev").alias("up")), "up")
    way, reach = cut(far.sparkSession.createDataFrame([(target, 0)], "id string, hops long"), "way"), 1
    while True:
        more = cut(way.join(far, "id").select(F.col("up").alias("id"), (F.col("hops") + reach).alias("hops")), "way")
        if not more.head(1):
            return [r.id for r in way.orderBy(F.desc("hops")).collect()]  # the answer itself
        way, reach = way.unionByName(more), 2 * reach
        far = cut(far.join(far.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")), "up")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): distinct neighbours in both directions, without loops. Edges are written once and told apart in as many tasks as
    there are EDGE_ROWS of them, so that a task's memory does not grow with the graph."""
    seen = Observation()
    ends = edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    ends = cut(ends.observe(seen, F.count(F.lit(1)).alias("n")), "ends")
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen.get["n"] // EDGE_ROWS))
    once = ends.repartition(parts, "a", "b").distinct()
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _degrees(near: DataFrame) -> DataFrame:
    return near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    return _degrees(undirected(edges))


def similarity(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, jaccard, adamic_adar) of given pairs; all 0 where nothing is shared."""
    near = undirected(edges)
    deg = _degrees(near)
    pairs = pairs.select("a", "b").distinct()
    z = pairs.join(near.select("a", F.col("b").alias("z")), "a").join(near.select(F.col("a").alias("b"), F.col("b").alias("z")), ["b", "z"])
    shared = z.join(deg.withColumnRenamed("id", "z"), "z").groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.when(F.col("degree") > 1, 1 / F.log("degree")).otherwise(0.0)).alias("adamic_adar"))
    of = lambda c: deg.select(F.col("id").alias(c), F.col("degree").alias(f"d_{c}"))
    out = pairs.join(shared, ["a", "b"], "left").join(of("a"), "a", "left").join(of("b"), "b", "left").fillna({"common": 0, "adamic_adar": 0.0, "d_a": 0, "d_b": 0})
    either = F.col("d_a") + F.col("d_b") - F.col("common")
    return out.select("a", "b", "common", F.when(either > 0, F.col("common") / either).otherwise(0.0).alias("jaccard"), "adamic_adar")


def link_prediction(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, score): the k best pairs a < b by Adamic-Adar that share a neighbour and are not adjacent; scores that agree to 9
    decimals are ties, which go by a, then b. A node with d neighbours has d*d/2 pairs, so pairs are never rows: nodes are
    dealt to blocks, each two blocks meet in a task that adds up the scores between them and keeps its own k best, and what is
    shuffled is the graph once for each block."""
    ends = cut(edges.filter("source <> target").select("source", "target"), "ends")
    ids = cut(numbered(ends.select(F.explode(F.array("source", "target")).alias("id")).distinct(), ["id"], "idx"), "ids")
    kind = "int" if ids.count() < 1 << 31 else "long"
    of = lambda c, to: ids.select(F.col("id").alias(c), F.col("idx").cast(kind).alias(to))
    e = ends.join(of("source", "a"), "source").join(of("target", "b"), "target").select("a", "b")
    near = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near")
    n = near.count()
    m = max(-(-n // HUB_ROWS), min(8, -(-n // 100_000)), 1)
    most = PAIRS  # as it is here, not where tasks run
    at = lambda c, to: F.pmod(F.col(c), F.lit(m)).cast("int").alias(to)
    rows = near.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near"))
    left = rows.select("a", "near", at("a", "i")).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(m - 1))))
    degree = near.groupBy(F.col("a").alias("z")).agg(F.count("*").alias("degree"))
    own = near.groupBy(F.col("a").alias("z"), at("b", "j")).agg(F.collect_list(F.floor(F.col("b") / m).cast(kind)).alias("own"))
    right = own.join(degree, "z").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))

    def run(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        a, b, s = _best_pairs(x, y, m, key[1].as_py(), key[0] == key[1], k, most)
        return pa.table({"lo": np.minimum(a, b), "hi": np.maximum(a, b), "score": s})

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "lo long, hi long, score double")
    top = cut(best.orderBy(F.desc(F.round("score", 9)), "lo", "hi").limit(k), "best")
    named = top.join(ids.select(F.col("idx").alias("lo"), F.col("id").alias("a")), "lo").join(ids.select(F.col("idx").alias("hi"), F.col("id").alias("b")), "hi")
    out = cut(named.select("a", "b", "score"), "links").orderBy(F.desc(F.round("score", 9)), "a", "b")
    drop(ends, ids, near, top)
    return out


def _best_pairs(x: pa.Table, y: pa.Table, m: int, j: int, same: bool, k: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of the nodes `a` of x, with their neighbours, and those of block j, which y holds by neighbour z as
    numbers within the block. Sums are made for as many rows as have `most` summands, or for parts of one row that has more."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not x.num_rows or not y.num_rows:
        return none
    flat = lambda t, c: (lambda v: (v.offsets.to_numpy(), v.values.to_numpy()))(pa.concat_arrays([*t.column(c).chunks]))
    a, (begin, near), (start, own) = x.column("a").to_numpy().astype(np.int64), flat(x, "near"), flat(y, "own")
    z, weight = y.column("z").to_numpy(), 1 / np.log(np.maximum(y.column("degree").to_numpy(), 2))
    order = np.argsort(z)
    place = np.searchsorted(z[order], near)
    met = place < len(z)
    met[met] = z[order[place[met]]] == near[met]
    place = order[place[met]]  # of each neighbour that y has
    begin = np.concatenate([[0], np.cumsum(met)])[begin]
    size, mine = np.diff(start), near % m == j
    ends = np.concatenate([[0], np.cumsum(size[place])])
    width, first = int(own.max()) + 1 if len(own) else 1, x.column("near").combine_chunks().offsets.to_numpy()

    def sums(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(number in the block, weight) of all summands of the neighbours lo to hi."""
        p = place[lo:hi]
        many = size[p]
        which = np.repeat(start[p] - (ends[lo:hi] - ends[lo]), many) + np.arange(ends[hi] - ends[lo])
        return own[which], np.repeat(weight[p], many)

    held, bar = [none], 0.0
    row = 0
    while row < len(a):
        last = max(row + 1, int(np.searchsorted(ends[begin], ends[begin[row]] + most, "right")) - 1)
        last = min(last, len(a))
        lo, hi = begin[row], begin[last]
        total = int(ends[hi] - ends[lo])
        nodes = np.arange(row, last)
        if last == row + 1 and total > most:
            score = np.zeros(width)
            while lo < hi:
                to = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
                score += np.bincount(*sums(lo, min(to, hi)), minlength=width)
                lo = min(to, hi)
            keys = np.arange(width)
        elif total:
            b, w = sums(lo, hi)
            key = np.repeat(nodes - row, ends[begin[row + 1 : last + 1]] - ends[begin[row:last]]) * width + b
            if (last - row) * width <= 4 * total:
                keys, score = np.arange((last - row) * width), np.bincount(key, w, (last - row) * width)
            else:
                keys, inverse = np.unique(key, return_inverse=True)
                score = np.bincount(inverse, w)
        else:
            row = last
            continue
        good = np.flatnonzero((score > 0) & (score >= bar - 1e-8))
        keys, score = keys[good], score[good]
        if len(keys):
            r, b = keys // width, keys % width * m + j
            own_pair = b > a[row + r] if same else np.ones(len(b), bool)
            s0, s1 = first[row], first[last]
            tied = np.repeat(nodes - row, np.diff(first[row : last + 1]))[mine[s0:s1]] * width + near[s0:s1][mine[s0:s1]] // m
            keep = own_pair & ~np.isin(keys, tied)
            held.append((a[row + r[keep]], b[keep], score[keep]))
            if sum(len(h[0]) for h in held) > 4 * k + 10_000:
                held = [_first_pairs(held, k)]
                bar = float(held[0][2].min()) if len(held[0][2]) == k else 0.0
        row = last
    return _first_pairs(held, k)


def _first_pairs(held: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, s = (np.concatenate([h[i] for h in held]) for i in range(3))
    top = np.lexsort((np.maximum(a, b), np.minimum(a, b), -np.round(s, 9)))[:k]
    return a[top], b[top], s[top]
