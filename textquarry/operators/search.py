"""Keyword, trigram BM25 and CJK search, and rank fusion.

Ranked lists are rows (query_id, list_id, pos, id, score, text); every rank ends with id as the tie-break unless input
position is asked for.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.plans.rounds import cut, drop


def keyword_search(docs: DataFrame, query: str, k: int, text: str = "text", pos: str = "pos") -> DataFrame:
    """Term frequency over lower-cased white-space terms (a repeated term counts again), best k, ties in input order."""
    terms = [t for t in query.lower().split() if t]
    low = F.lower(text)
    counts = [((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in terms]
    score = reduce(lambda a, b: a + b, counts, F.lit(0).cast("long"))
    return docs.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), pos).limit(k)


def _occurrences(column: Column, query: str) -> Column:
    """Overlapping occurrences, case-insensitive, in time linear in the text: a look-ahead fits at each of them and takes no room."""
    low, q = F.lower(column), query.lower()
    quoted = "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in q)
    return F.when(F.contains(low, F.lit(q)), F.regexp_count(low, F.lit(f"(?={quoted})"))).otherwise(0)


def bm25_search(nodes: DataFrame, query: str, k: int | None = None, columns: tuple[str, ...] = ("title", "body", "tags")) -> DataFrame:
    """Literal phrase search with BM25 over trigrams: add `bm25` (lower is better), order by it, importance, id.

    A row matches where one of the columns holds the phrase, in any case; phrases below three characters match nothing.
    """
    if len(query) < 3:
        return nodes.withColumn("bm25", F.lit(0.0)).limit(0)
    flat = {c: F.coalesce(F.array_join(c, ",") if dict(nodes.dtypes)[c].startswith("array") else F.col(c), F.lit("")) for c in columns}
    grams = reduce(lambda a, b: a + b, (F.greatest(F.length(c) - 2, F.lit(0)) for c in flat.values()))
    tf = reduce(lambda a, b: a + b, (_occurrences(c, query) for c in flat.values()))
    rows = nodes.withColumns({"_d": grams, "_tf": tf})
    stats = rows.agg(F.count("*").alias("_n"), F.sum((F.col("_tf") > 0).cast("long")).alias("_m"), F.avg("_d").alias("_avg"))
    idf = F.log((F.col("_n") - F.col("_m") + 0.5) / (F.col("_m") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    score = -idf * F.col("_tf") * 2.2 / (F.col("_tf") + 1.2 * (0.25 + 0.75 * F.col("_d") / F.col("_avg")))
    hits = rows.filter("_tf > 0").join(F.broadcast(stats)).withColumn("bm25", score).drop("_d", "_tf", "_n", "_m", "_avg")  # stats is one row
    ranked = hits.orderBy("bm25", F.desc("importance"), "id")
    return ranked.limit(k) if k is not None else ranked


def terms_search(nodes: DataFrame, query: str, k: int | None = None, columns: tuple[str, ...] = ("title", "body", "tags"), joined: bool = False) -> DataFrame:
    """Every white-space term is a substring of one of the columns (joined: of all of them in one string), in any case;
    by importance (joined: then by updated, newest first)."""
    flat = [F.lower(F.coalesce(F.array_join(c, ",") if dict(nodes.dtypes)[c].startswith("array") else F.col(c), F.lit(""))) for c in columns]
    flat = [F.concat_ws(" ", *flat)] if joined else flat
    terms = query.lower().split()
    if not terms:
        return nodes.limit(0)
    fits = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for c in flat)) for t in terms))
    order = [F.desc("importance"), *([F.desc("updated")] if joined else []), "id"]
    ranked = nodes.filter(fits).orderBy(*order)
    return ranked.limit(k) if k is not None else ranked


def hybrid_search(nodes: DataFrame, query: str, k: int) -> DataFrame:
    """BM25 hits first, then further hits of the CJK substring search, each id once."""
    a = bm25_search(nodes, query, k).select("*", F.lit(0).alias("_source"))
    b = terms_search(nodes, query, k).select("*", F.lit(0.0).alias("bm25"), F.lit(1).alias("_source")).join(a.select("id"), "id", "left_anti").select(a.columns)
    return a.unionByName(b).orderBy("_source", "bm25", F.desc("importance"), "id").limit(k).drop("_source")


def with_rank(hits: DataFrame, keys: tuple[str, ...] = ("query_id", "list_id")) -> DataFrame:
    """Add pos: 1 for a list's best hit."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))


def _fused(hits: DataFrame, score: Column) -> DataFrame:
    first = F.min_by("text", F.struct("list_id", "pos")) if "text" in hits.columns else F.lit(None).cast("string")
    return hits.groupBy("query_id", "id").agg(score.alias("score"), first.alias("text"))


def _weight(weights: dict) -> Column:
    """The weight of a row's list; an error for a list that has none."""
    known = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.lit(None).cast("map<string,double>")
    return F.coalesce(F.try_element_at(known, F.col("list_id")), F.raise_error(F.concat(F.lit("no weight for list "), F.col("list_id"))).cast("double"))


def rrf(hits: DataFrame, k: int = 60, weights: dict | None = None) -> DataFrame:
    """Sum of weight/(k + pos) over the lists. `weights` must name every list that is told here."""
    w = F.lit(1.0) if weights is None else _weight(weights)
    return _fused(hits, F.sum(w / (k + F.col("pos"))))


def normalize_minmax(hits: DataFrame, keys: tuple[str, ...] = ("query_id", "list_id")) -> DataFrame:
    """Scores to 0..1 within a list: non-finite count as 0 first, and all are 1 where they are all equal."""
    s = F.when(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf")), 0.0).otherwise(F.col("score").cast("double"))
    w = Window.partitionBy(*keys)
    span = F.max(s).over(w) - F.min(s).over(w)
    return hits.withColumn("score", F.when(span < 1.1920929e-07, 1.0).otherwise((s - F.min(s).over(w)) / span))


def weighted_sum(hits: DataFrame, weights: dict) -> DataFrame:
    """Sum of weight * score over the lists. `weights` must name every list."""
    return _fused(hits, F.sum(_weight(weights) * F.col("score")))


def comb_mnz(hits: DataFrame, k: int) -> DataFrame:
    """Sum of scores times the number of lists that have the id among their first k."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return _fused(hits, F.sum("score") * F.sum(F.when(F.col("pos") <= k, 1).otherwise(0)))


def top(hits: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k)


def federate(lists: dict[str, DataFrame], k: int, strategy: str = "rrf") -> DataFrame:
    """Fuse the hits (query_id, id, score[, text]) of several backends, each asked for its best 2k, and keep k."""
    if not lists:
        raise ValueError("no backend")
    if strategy not in ("rrf", "weighted"):
        raise ValueError(strategy)
    each = [top(df, 2 * k).drop("rank").withColumn("list_id", F.lit(name)) for name, df in lists.items()]
    hits = with_rank(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each))
    fused = rrf(hits) if strategy == "rrf" else weighted_sum(normalize_minmax(hits), {n: 1.0 / len(lists) for n in lists})
    return top(fused, k)


class AllBackendsFailed(Exception):
    """No backend answered; `errors` says why, by name."""

    def __init__(self, errors: dict[str, str]):
        super().__init__(f"no backend answered: {errors}")
        self.errors = errors


def federate_answering(backends: dict[str, Callable[[], DataFrame]], k: int, strategy: str = "rrf", seconds: float = 30.0) -> tuple[DataFrame, dict[str, str]]:
    """federate() over the backends that answer within `seconds`: (fused hits, {name: what went wrong}).

    Each backend builds its hits in a thread of its own and runs them as Spark jobs with a tag of their own, at the same time as
    the others. One that raises, or whose jobs are cancelled by their tag when time is up, is left out; if none is left, that is an error. What
    a backend found is a table in the shared folder, so fusing it asks nobody again."""
    if not backends:
        raise ValueError("no backend")
    spark = SparkSession.active()
    found: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    tags = {name: f"backend-{uuid.uuid4().hex}" for name in backends}
    late: set[str] = set()

    def ask(name: str) -> None:
        spark.sparkContext.addJobTag(tags[name])
        try:
            hits = cut(top(backends[name](), 2 * k).drop("rank"), "hits")
            if name in late:
                drop(hits)
            else:
                found[name] = hits
        except Exception as e:  # noqa: BLE001  a backend may fail in any way; the caller is told
            errors.setdefault(name, f"{type(e).__name__}: {e}")
        finally:
            spark.sparkContext.removeJobTag(tags[name])

    threads = {name: InheritableThread(target=ask, args=(name,), session=spark, daemon=True) for name in backends}
    for t in threads.values():
        t.start()
    end = time.monotonic() + seconds
    for name, t in threads.items():
        t.join(max(0.0, end - time.monotonic()))
        if t.is_alive():
            late.add(name)
            found.pop(name, None)
            errors[name] = f"no answer within {seconds} s"
            spark.sparkContext.cancelJobsWithTag(tags[name])
    if not found:
        raise AllBackendsFailed(errors)
    return federate({name: found[name] for name in backends if name in found}, k, strategy), errors
