"""A graph laid out once for algorithms in rounds: nodes are dense numbers, edges lie in buckets by source and by target.

The algorithms then shuffle numbers only, never ids, and never the edges: a round's join reads each bucket of edges where the
values of its nodes are. One snapshot serves any number of runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textquarry.plans.rounds import cut, cut_by, drop, numbered

IMPASSABLE = 1e-9
#: Label propagation takes connected components of up to so many nodes and edges through tasks (some 100 bytes each), larger ones
#: by joins. Groups of components have about a quarter of it.
GROUP_ROWS = 2_000_000
#: Components are found in one task where no more edges than these are left.
LAST_EDGES = 500_000
#: Ends of edges are looked up in tables made in tasks where there are more nodes than this, but no more in a task.
HASHED = 1_000_000
_PLACE = (1 << 40) - 1


def edge_cost(weight: Column) -> Column:
    """-ln of the weight, 1 at most; null where it can't be passed."""
    return F.when(weight >= IMPASSABLE, -F.log(F.least(weight, F.lit(1.0))) + 0.0)


def edge_cap(nodes: int) -> int:
    """A bound on edges in proportion to nodes, for callers that want one."""
    return max(2_000, 64 * nodes)


def _hashed(nodes: DataFrame, n: int) -> DataFrame:
    """Many nodes, but few in a task, are joined by a table made there, so that the edges, which are more, need not be sorted."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.hint("shuffle_hash") if HASHED < n <= HASHED * parts else nodes


@dataclass
class Snapshot:
    """ids: (id, idx) by idx, from 0 to n - 1. out: (src, dst, weight) by src; into: the same by dst, made when it is first asked for."""

    ids: DataFrame
    out: DataFrame
    n: int
    _held: list[DataFrame] = field(default_factory=list)
    _of: DataFrame | None = None
    _into: DataFrame | None = None
    _rooted: tuple[DataFrame, bool] | None = None

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, order: str = "id", most_edges: int | None = None) -> Snapshot:
        """Nodes are numbered in the order of `order` and id, each id once; edges with an end that is no node are left out.
        most_edges: only so many edges by their id (a feature for bounded views; none by default)."""
        keys = [order, "id"] if order != "id" else ["id"]
        some = nodes.filter("id is not null")
        own = some.select("id").distinct() if order == "id" else some.groupBy("id").agg(F.min(order).alias(order))
        ids = cut_by(numbered(own, keys, "idx").select("id", "idx"), "ids", "idx")
        n = ids.count()
        if most_edges is not None:
            edges = numbered(edges, ["id"], "_nth").filter(F.col("_nth") < most_edges)
        ends = _hashed(ids, n)
        end = lambda c, as_: ends.select(F.col("id").alias(c), F.col("idx").alias(as_))
        both = edges.select("source", "target", "weight").join(end("source", "src"), "source").join(end("target", "dst"), "target")
        return cls(ids, cut_by(both.select("src", "dst", "weight"), "out", "src"), n)

    @property
    def into(self) -> DataFrame:
        if self._into is None:
            self._into = cut_by(self.out, "into", "dst")
        return self._into

    def drop(self) -> None:
        drop(self.ids, self.out, self._into, *self._held)

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """`df` with ids in place of the numbers in `columns`."""
        for c in columns:
            df = df.join(self.ids.select(F.col("idx").alias(c), F.col("id").alias("_id")), c, "left").drop(c).withColumnRenamed("_id", c)
        return df

    def pagerank(self, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
        """(idx, rank), adding up to 1. Weighted shares; nodes without weight out spread theirs evenly; stops when a round moves
        less than `tolerance` in sum. A round is one job: its own write tells how much it moved."""
        n = self.n
        if n == 0:
            return self.ids.select("idx", F.lit(0.0).alias("rank"))
        total = self.out.groupBy("src").agg(F.sum("weight").alias("total")).filter("total > 0")
        shares = cut_by(self.out.join(_hashed(total, n), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares", "src", placed=True)
        seen = Observation()
        first = self.ids.select("idx").join(total.select(F.col("src").alias("idx"), F.lit(False).alias("sink")), "idx", "left").select("idx", F.coalesce("sink", F.lit(True)).alias("sink"), F.lit(1.0 / n).alias("rank"))
        rank = cut_by(first.observe(seen, F.count(F.when(F.col("sink"), 1)).alias("lost")), "rank", "idx", placed=True)
        lost = seen.get["lost"] / n
        for _ in range(rounds):
            got = _hashed(rank.filter(~F.col("sink")).select(F.col("idx").alias("src"), "rank"), n).join(shares, "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            base = (1 - damping) / n + damping * lost / n
            new = rank.join(got, rank.idx == got.dst, "left").select("idx", "sink", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
            seen = Observation()
            watched = new.observe(seen, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved"), F.sum(F.when(F.col("sink"), F.col("rank")).otherwise(0.0)).alias("lost"), F.sum("rank").alias("all"))
            held, rank = rank, cut_by(watched.drop("old"), "rank", "idx", placed=True)
            drop(held)
            lost = seen.get["lost"]
            if seen.get["moved"] < tolerance:
                break
        drop(shares)
        self._held.append(rank)
        sums = seen.get["all"] if "all" in seen.get else 1.0
        return rank.select("idx", (F.col("rank") / F.lit(sums)).alias("rank"))

    def components(self) -> DataFrame:
        """(idx, component): the smallest number that undirected edges reach."""
        if self._of is None:
            of, least = self._roots()
            if not least:
                low = of.groupBy("root").agg(F.min("idx").alias("component"))
                of = cut_by(of.join(low, "root").select("idx", "component"), "components", "idx")
                self._held.append(of)
            self._of = of.withColumnRenamed("root", "component")
        return self._of

    def _roots(self) -> tuple[DataFrame, bool]:
        """(idx, root): the same node for all that undirected edges connect, and whether it is the smallest of them.

        In a round each node goes to its neighbour (or itself) that is first in an order drawn for that round, and edges between
        those are left, among about half as many nodes; what is left at the last, some LAST_EDGES, is connected in one task."""
        if self._rooted is not None:
            return self._rooted
        if self.n > _PLACE:
            raise ValueError(f"more than {_PLACE} nodes")

        def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(u, to): the smallest node that each node of the edges (u, v) is connected with."""
            pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
            if not pairs:
                return
            names, at = np.unique(np.concatenate(pairs), return_inverse=True)
            a, b = at.reshape(-1, 2).T
            root = np.arange(len(names))
            while len(a):
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # roots go below the smallest root beside them
                while not np.array_equal(root[root], root):
                    root = root[root]
                a, b = root[a], root[b]
                a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["u", "to"])

        left, went, of = self.out.filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")), [], None
        n = left.count()
        while n > LAST_EDGES:
            drawn = lambda c: F.shiftleft(F.pmod(F.xxhash64(c, F.lit(len(went))), F.lit(1 << 23)), 40).bitwiseOR(F.col(c))
            first = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min(drawn("v")).alias("v"))
            first = first.select("u", F.least("v", drawn("u")).bitwiseAND(F.lit(_PLACE)).alias("to"))
            went.append(cut(first, "went") if went else cut_by(first, "went", "u", placed=True))  # the edges of the first round lie by u
            near = lambda df: df if len(went) > 1 else _hashed(df, self.n)
            to = lambda c: went[-1].select(F.col("u").alias(c), F.col("to").alias(f"to_{c}"))
            met = left.join(near(to("u")), "u").join(near(to("v")), "v").filter("to_u <> to_v")
            seen = Observation()
            met = met.select(F.greatest("to_u", "to_v").alias("u"), F.least("to_u", "to_v").alias("v")).distinct().observe(seen, F.count(F.lit(1)).alias("n"))
            held, left = left, cut(met, "left")
            drop(held)
            n = seen.get["n"]
        if n:
            of = left.coalesce(1).mapInArrow(connected, "u long, to long")
        for one in reversed(went):
            of = one if of is None else one.join(of.select(F.col("u").alias("to"), F.col("to").alias("end")), "to", "left").select("u", F.coalesce("end", "to").alias("to"))
        own = self.ids.select("idx")
        roots = own.withColumn("root", F.col("idx")) if of is None else own.join(of, F.col("idx") == F.col("u"), "left").select("idx", F.coalesce("to", "idx").alias("root"))
        roots = cut_by(roots, "roots", "idx", placed=True)
        drop(left, *went)
        self._held.append(roots)
        self._rooted = roots, not went
        return self._rooted

    def label_propagation(self, rounds: int = 10) -> DataFrame:
        """(idx, label): asynchronous propagation in the order of numbers: each node takes the label with most weight among its
        neighbours, the smallest among equals, until nothing changes.

        Updates never leave a connected component, so each goes its own way with the result of one sequential pass over all
        nodes: components of up to GROUP_ROWS nodes and edges in groups through tasks, larger ones by joins."""
        of = self._roots()[0].withColumnRenamed("root", "component")
        e = self.out.join(_hashed(of.select(F.col("idx").alias("src"), "component"), self.n), "src")
        sizes = cut(of.select("component").unionByName(e.select("component")).groupBy("component").agg(F.count("*").alias("n")), "sizes")
        large = F.col("n") > GROUP_ROWS
        s = sizes.agg(F.count(F.when(large, 1)).alias("large"), F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)).alias("rest")).first()
        members, groups = of, max(2 * int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-s.rest // max(1, GROUP_ROWS // 4)))
        out = None
        if s.large:
            big = F.broadcast(sizes.filter(large).select("component"))  # at most one for each GROUP_ROWS rows of the graph
            out = self._by_joins(members.join(big, "component", "left_semi"), e.join(big, "component", "left_semi"), rounds)
            members, e = members.join(big, "component", "left_anti"), e.join(big, "component", "left_anti")
        part = F.pmod(F.xxhash64("component"), F.lit(groups)).alias("part")

        def run(key: tuple, people: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            own = np.sort(people["idx"].to_numpy())
            a, b = np.searchsorted(own, links["src"].to_numpy()), np.searchsorted(own, links["dst"].to_numpy())
            ends, to = np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel()
            order = np.argsort(ends, kind="stable")
            to, weight = to[order], np.repeat(links["weight"].to_numpy(), 2)[order]
            begin = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(own)))]).tolist()
            label = np.arange(len(own))
            due = bytearray(b"\1" * len(own))  # whoever has a neighbour that changed since the last vote
            told = np.frombuffer(due, np.uint8)
            for _ in range(rounds):
                changed = False
                for i in range(len(own)):
                    lo, hi = begin[i], begin[i + 1]
                    if not due[i] or lo == hi:
                        continue
                    due[i] = 0
                    if hi - lo > 32:
                        labels, of_label = np.unique(label[to[lo:hi]], return_inverse=True)
                        new = int(labels[np.bincount(of_label, weight[lo:hi]).argmax()])
                    else:
                        votes: dict[int, float] = {}
                        for x, w in zip(label[to[lo:hi]].tolist(), weight[lo:hi].tolist(), strict=True):
                            votes[x] = votes.get(x, 0.0) + w
                        new = min(votes, key=lambda x: (-votes[x], x))
                    if new != label[i]:
                        label[i], changed = new, True
                        told[to[lo:hi]] = 1
                if not changed:
                    break
            return pd.DataFrame({"idx": own, "label": own[label]})

        small = members.select("idx", part).groupBy("part").cogroup(e.select("src", "dst", "weight", part).groupBy("part")).applyInPandas(run, "idx long, label long")
        return small if out is None else small.unionByName(out)

    def _by_joins(self, people: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
        """label_propagation() by joins and aggregates. In a round a node sees the new labels of earlier neighbours and the old
        ones of later ones. New labels start as the old ones; whoever has an input that changed votes again until none has,
        and as inputs only point back in the order, that is the sequential pass. It takes as many steps as the longest way
        that a change makes through ever later neighbours."""
        there = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
        both = there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
        near = cut_by(both, "near", "b")
        told = lambda by, earlier: cut(near.filter("b < a" if earlier else "b > a").join(by.select(F.col("idx").alias("b")), "b", "left_semi").select("a").distinct(), "active")
        held = cut(people.select("idx", F.col("idx").alias("old"), F.col("idx").alias("new"), F.lit(False).alias("moved")), "labels")
        state, active = held, None
        for _ in range(rounds):
            while True:
                asked = near if active is None else near.join(active, "a", "left_semi")
                votes = asked.join(state.select(F.col("idx").alias("b"), "old", "new"), "b").select("a", F.when(F.col("b") <= F.col("a"), F.when(F.col("b") == F.col("a"), F.col("old")).otherwise(F.col("new"))).otherwise(F.col("old")).alias("label"), "weight")
                won = votes.groupBy("a", "label").agg(F.sum("weight").alias("w")).groupBy("a").agg(F.min(F.struct((0.0 - F.col("w")).alias("w"), "label")).alias("won"))
                now = state.drop("moved").join(won.select(F.col("a").alias("idx"), F.col("won.label").alias("label")), "idx", "left")
                new = cut(now.select("idx", "old", F.coalesce("label", "new").alias("new"), F.coalesce(F.col("label") != F.col("new"), F.lit(False)).alias("moved")), "labels")
                drop(held, active)
                state = held = new
                active = told(state.filter("moved"), True)
                if not active.head(1):
                    break
            drop(active)
            active = told(state.filter("new <> old"), False)
            state = state.select("idx", F.col("new").alias("old"), "new", F.lit(False).alias("moved"))
            if not active.head(1):
                break
        drop(near, active)
        self._held.append(held)
        return state.select("idx", F.col("new").alias("label"))

    def distances(self, source: str) -> DataFrame:
        """(idx, dist, prev) of all nodes that directed edges reach. Each round relaxes only nodes that have just improved."""
        costs = self.out.select("src", "dst", edge_cost(F.col("weight")).alias("cost")).filter("cost is not null").groupBy("src", "dst").agg(F.min("cost").alias("cost"))
        best = active = cut(self.ids.filter(F.col("id") == source).select("idx", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev")), "best")
        while active.head(1):
            offers = active.withColumnRenamed("idx", "src").join(costs, "src").select(F.col("dst").alias("idx"), (F.col("dist") + F.col("cost")).alias("d"), F.col("src").alias("p"))
            offers = offers.groupBy("idx").agg(F.min(F.struct("d", "p")).alias("o"))
            better = offers.join(best, "idx", "left").filter("dist is null or o.d < dist - 1e-15").select("idx", F.col("o.d").alias("dist"), F.col("o.p").alias("prev"))
            held, active = active if active is not best else None, cut(better, "active")
            drop(held)
            held, best = best, cut(best.join(active.select("idx"), "idx", "left_anti").unionByName(active), "best")
            drop(held)
        drop(active if active is not best else None)
        self._held.append(best)
        return best


__all__ = ["GROUP_ROWS", "Snapshot", "edge_cap", "edge_cost"]
