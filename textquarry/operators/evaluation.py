"""Quality metrics as aggregates: estimate errors, label sets, and ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def estimate_errors(rows: DataFrame, estimated: str, actual: str) -> DataFrame:
    """One row: entries, mae, max_error, and the per cent of rows off by 3 at most and by a tenth of a positive actual at most."""
    off = F.abs(F.col(estimated) - F.col(actual)).cast("double")
    percent = lambda c: F.sum(F.when(c, 1).otherwise(0)) / F.count("*") * 100.0
    return rows.agg(
        F.count("*").alias("entries"), F.avg(off).alias("mae"), F.max(off).alias("max_error"), percent(off <= 3).alias("pct_within_3"), percent((F.col(actual) > 0) & (off <= 0.1 * F.col(actual))).alias("pct_within_10pct")
    )


def label_sets(rows: DataFrame, found: str, expected: str) -> DataFrame:
    """One row: precision, recall and f1 over the labels of all rows together (arrays of distinct labels); 1 where nothing
    was found, or expected."""
    hits = F.coalesce(F.sum(F.size(F.array_intersect(found, expected))), F.lit(0))
    p, r = _share(hits, F.sum(F.size(found)), 1.0), _share(hits, F.sum(F.size(expected)), 1.0)
    return rows.agg(p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def set_scores(rows: DataFrame, found: str, expected: str) -> DataFrame:
    """Add precision, recall and f1 of each row's two sets."""
    hits = F.size(F.array_intersect(found, expected))
    p, r = _share(hits, F.size(found), 1.0), _share(hits, F.size(expected), 1.0)
    return rows.withColumns({"precision": p, "recall": r, "f1": _f1(p, r)})


def ranking_scores(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """For each query of `relevant` (query_id, id): precision and recall among its first k of `ranked` (query_id, id, rank)
    and the reciprocal rank of its first relevant hit; 0 where it has none."""
    wanted = relevant.select("query_id", "id").distinct()
    hits = ranked.join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hits"), F.min("rank").alias("first"))
    each = wanted.groupBy("query_id").agg(F.count("*").alias("n")).join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return each.select("query_id", (F.col("hits") / k).alias(f"p_at_{k}"), (F.col("hits") / F.col("n")).alias(f"r_at_{k}"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def mean_scores(scores: DataFrame) -> DataFrame:
    """One row: the mean of every score over the queries; rr becomes mrr."""
    return scores.agg(*(F.avg(c).alias("mrr" if c == "rr" else c) for c in scores.columns if c != "query_id"))
