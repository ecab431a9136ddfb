"""Composite recall: recency, importance, use and match, then a PageRank boost among the best."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators.graph_store import NodeQuery, edges_among, epoch, in_scope, touch
from textquarry.operators.search import hybrid_search

# Weights of the score's parts, and days in which recency halves.
RECENCY, IMPORTANCE, USE, MATCH, BOOST, HALF_LIFE = 0.20, 0.35, 0.15, 0.20, 0.10, 30
BOOSTED = 100


@dataclass
class RecallOptions:
    hint: str = ""
    limit: int = 10
    scope: NodeQuery = field(default_factory=NodeQuery)
    gate_by_hint: bool = True


def recency(updated: Column | str, now: str) -> Column:
    """0.5 for unknown and future times, else halved every 30 days."""
    at, today = epoch(updated), epoch(F.lit(now))
    return F.when((at == 0) | (at > today), 0.5).otherwise(F.exp(-(today - at) / 86400.0 * np.log(2) / HALF_LIFE))


def candidates(nodes: DataFrame, o: RecallOptions, now: str) -> DataFrame:
    """The nodes that recall scores, with score, before the boost: the best `limit`."""
    fresh = nodes.filter(~F.array_contains("tags", "stale") & in_scope(o.scope))
    match = F.lit(0.0)
    if o.hint:
        hits = hybrid_search(nodes, o.hint, 4 * o.limit).select("id", F.lit(1.0).alias("_hit"))
        if o.gate_by_hint:
            some = fresh.join(hits, "id")
        else:
            window = fresh.orderBy(F.desc("importance"), F.desc("updated"), "id").limit(max(4 * o.limit, 40))
            some = window.join(hits, "id", "left")
        match = F.coalesce("_hit", F.lit(0.0))
    else:
        some = fresh.orderBy(F.desc("importance"), F.desc("updated"), "id").limit(max(4 * o.limit, 40))
    use = F.least(F.greatest(F.col("access_count"), F.lit(0)) / 20, F.lit(1.0))
    score = RECENCY * recency("updated", now) + IMPORTANCE * F.col("importance") + USE * use + MATCH * match
    return some.withColumn("score", score).drop("_hit").orderBy(F.desc("score"), "id").limit(o.limit)


def recall(nodes: DataFrame, edges: DataFrame, o: RecallOptions, now: str) -> DataFrame:
    """Nodes with score, best first. Of at most BOOSTED rows the PageRank among them, relative to its maximum, is added;
    that graph is a top-k result and so bounded, and goes through one group."""
    best = candidates(nodes, o, now)
    rows = best.select("id", "score")
    links = edges_among(edges, rows.orderBy(F.desc("score"), "id").limit(BOOSTED)).select("source", "target", "weight")
    packed = rows.agg(F.collect_list(F.struct("id", "score")).alias("rows")).join(F.broadcast(links.agg(F.collect_list(F.struct("source", "target", "weight")).alias("links"))))

    def boost(batches):
        for batch in batches:
            for people, ties in zip(batch["rows"], batch["links"], strict=True):
                people = sorted(((p["id"], p["score"]) for p in people), key=lambda x: (-x[1], x[0]))
                ranks = _pagerank([p[0] for p in people[:BOOSTED]], [(t["source"], t["target"], t["weight"]) for t in ties]) if len(people) > 1 else {}
                top = max(ranks.values(), default=0.0)
                yield pd.DataFrame([(i, s + (BOOST * ranks.get(i, 0.0) / top if top else 0.0)) for i, s in people], columns=["id", "score"])

    boosted = packed.mapInPandas(boost, "id string, score double")
    return nodes.join(boosted, "id").orderBy(F.desc("score"), "id")


def recall_and_touch(nodes: DataFrame, edges: DataFrame, o: RecallOptions, now: str) -> tuple[DataFrame, DataFrame]:
    """recall() and the nodes as they are afterwards: those recalled count as read once more, at `now`."""
    found = recall(nodes, edges, o, now)
    return found, touch(nodes, [r.id for r in found.select("id").collect()], now)  # o.limit ids at most


def _pagerank(ids: list[str], edges: list[tuple], damping: float = 0.85, rounds: int = 100) -> dict[str, float]:
    at, n = {x: i for i, x in enumerate(ids)}, len(ids)
    m = np.zeros((n, n))
    for a, b, w in edges:
        if a in at and b in at:
            m[at[b], at[a]] += w
    out = m.sum(0)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    r = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (m @ r + r[out <= 0].sum() / n)
        done, r = np.abs(new - r).sum() < 1e-6, new
        if done:
            break
    return dict(zip(ids, (r / r.sum()).tolist(), strict=True))
