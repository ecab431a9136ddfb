"""What the training-data operators share: tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.plans.rounds import cut
from textquarry.plans.rounds import drop, shared_dir


def save(df: DataFrame, what: str) -> DataFrame:
    """cut(); then lets Spark's cleaner delete the shuffle files of tables that were dropped."""
    out = cut(df, what)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Spark hands at most `rows` rows at a time to Python; for long texts, which an executor holds several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of undirected `edges` by alternating large-star and small-star steps.

    Returns (node, component): the smallest node reachable, for every node on an edge. Nulls and self-loops are ignored.
    Each step is a minimum per node (combined before the shuffle) and a join back, so a node with many edges is
    aggregated in parts and its join partition can be split; nothing is gathered per node or on the driver.
    """
    key = dict(edges.dtypes)[src]
    old = save(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "edges"
    )
    state = None
    while True:
        both = old.unionByName(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(old)
        old = new
        if now == state:
            break
        state = now
    stars = old.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = old.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots).select(F.col("node").cast(key), F.col("component").cast(key))


#: Bits of the table that tells tasks which keys may matter, as a power of two: so many at least, and at most (32 MB).
LEAST_BITS, MOST_BITS = 26, 28


def bit_table(keys: DataFrame, column: str, n: int = 0) -> np.ndarray:
    """A power of two of bits, about 16 for each of the `n` keys that are expected, set at the low bits of each of the long
    `keys`. It spares most other keys the way to a join, which then decides; where there are so many keys that it fills
    up, it only spares less."""
    size = min(max(LEAST_BITS, (16 * n).bit_length()), MOST_BITS)
    low = F.col(column).bitwiseAND((1 << size) - 1)
    words = keys.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(`{column}` & 63L))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << size - 6, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint64)
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not in `ids` (doc_id). Only rows that the bit table cannot rule out are shuffled."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(ids, "doc_id"))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(may_hold(table.value, keys.fillna(-1).to_numpy(np.int64)))

    near = maybe(F.col("doc_id").cast("long"))
    return docs.filter(~near).unionByName(docs.filter(near).hint("merge").join(ids, "doc_id", "left_anti").select(docs.columns))


__all__ = ["arrow_rows", "bit_table", "components", "drop", "may_hold", "save", "shared_dir", "table", "without"]
