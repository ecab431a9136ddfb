"""Mixing sources to target weights: fixed-length blocks of words, dealt to output shards by multinomial draws."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textquarry.llm.common import drop, save

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a source that are numbered apart, shards whose counts are, and intervals in which a draw looks up its source.
PARTS, SHARDS, INTERVALS = 65_536, 4_096, 1 << 20
#: Up to so many sources go to the tasks as a table; more are joined.
TOLD_SOURCES = 100_000
_ROUNDS = 6
_BEFORE = (Window.unboundedPreceding, -1)


def running(df: DataFrame, order: str, **sums: Column) -> DataFrame:
    """Add to `df`, for each name, the sum of its column over the rows before, in the order of `order` (unique). Range partitions
    are summed apart and start from the sums of those before, of which there is one row for each partition."""
    laid = save(df.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "laid")
    per = laid.groupBy("_part").agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in sums))
    whole, own = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(*_BEFORE), Window.partitionBy("_part").orderBy(order).rowsBetween(*_BEFORE)
    begin = per.select("_part", *(F.coalesce(F.sum(f"_all_{n}").over(whole), F.lit(0)).alias(f"_all_{n}") for n in sums))
    out = laid.join(F.broadcast(begin), "_part").withColumns({n: F.col(f"_all_{n}") + F.coalesce(F.sum(f"_{n}").over(own), F.lit(0)) for n in sums})
    return out.select(*df.columns, *sums)


def permute_each(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each index in [0, n) under the permutation of its own key: a Feistel network over the least even number of bits
    that holds n, walked along its cycle until it is below n."""
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(np.float64)) / 2), 1).astype(np.uint64)
    half += (np.uint64(1) << (half + half)) < n  # where the logarithm was rounded down
    low, todo = (np.uint64(1) << half) - np.uint64(1), np.flatnonzero(x < n)  # others stay as they are
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> half[todo], x[todo] & low[todo]
            for r in range(_ROUNDS):
                z = right + key[todo] + np.uint64((r + 1) * 0xD1B54A32D192ED03 % 2**64)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & low[todo])
            x[todo] = (left << half[todo]) | right
            todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


@F.pandas_udf(LongType())
def _permuted(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute_each(index.to_numpy(), n.to_numpy(), key.to_numpy()))


@dataclass
class Mix:
    """rows: (doc_id, source, size, src, at), at the place of a document's first word among those of its source. sources: (src,
    source, source_size, target, ...). slots: (shard, slot, src, epoch, block, length), a block of a source in each. Tables in the shared folder."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int
    n_sources: int

    def drop(self) -> None:
        drop(self.rows, self.sources, self.slots)


def numbered(docs: DataFrame, seed: int, text: bool = False) -> DataFrame:
    """(doc_id, source, size, src, at[, words]): documents in an order that their ids' hashes give, each with the place of its first
    word in its source. src orders sources by code point, null last. Parts of a source are added up first, so a source with
    any share of the rows is spread over many tasks."""
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    size = F.size(words) if text else F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    source = F.col("source").cast("string")
    src = F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))
    own = docs.select(
        "doc_id", source.alias("source"), size.cast("long").alias("size"), src.alias("src"), F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(PARTS)).alias("part"),
        F.xxhash64(F.col("text").cast("string")).alias("same"), *([words.alias("words")] if text else []),
    )
    kept = save(own, "sizes")
    sums = kept.groupBy("src", "part").agg(F.sum("size").alias("sum"))
    begin = sums.select("src", "part", F.coalesce(F.sum("sum").over(Window.partitionBy("src").orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("begin"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("src", "part").orderBy("doc_id", "size", "same").rowsBetween(*_BEFORE)), F.lit(0))
    at = kept.hint("merge").join(begin, ["src", "part"]).withColumn("at", F.col("begin") + within)
    out = save(at.select("doc_id", "source", "size", "src", "at", *(["words"] if text else [])), "numbered")
    drop(kept)
    return out


def targets(rows: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """((src, source, source_size, weight, target), their number). Weights repeat over the sources in order; targets share all
    words by weight, stop at `most` times a source's words, and the excess goes on by weight to the others until none is above.

    The words for each unit of weight only rise from round to round, so a round is one sum over the sources."""
    sums = rows.groupBy("src").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = running(sums, "src", rank=F.lit(1).cast("long"))
    each = F.array(*(F.lit(w) for w in weights))
    table = save(ranked.withColumn("weight", F.get(each, (F.col("rank") % len(weights)).cast("int")).cast("long")), "sources")
    total, share, n = table.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    over, units = total or 0, share or 1
    wide = lambda c: F.lit(c).cast("decimal(19,0)") if isinstance(c, int) else c.cast("decimal(12,0)")

    def above(over: int, units: int) -> Column:
        return wide(over) * wide(F.col("weight")) > (F.col("source_size") * most).cast("decimal(19,0)") * wide(units)

    while True:
        full, rest = table.agg(F.sum(F.when(above(over, units), F.col("source_size"))), F.sum(F.when(~above(over, units), F.col("weight")))).first()
        now = ((total or 0) - most * (full or 0), rest or 1)
        if now == (over, units):
            break
        over, units = now
    target = F.when(above(over, units), (F.col("source_size") * most).cast("double")).otherwise(F.lit(over) * F.col("weight") / F.lit(units))
    out = table.select("src", "source", "source_size", "weight", target.alias("target"))
    out.cut_at = table.cut_at
    return out, n


def _by_source(df: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    return df.join(F.broadcast(sources), "src") if n <= TOLD_SOURCES else df.hint("merge").join(sources, "src")


def _dealt(sources: DataFrame, n: int, per_shard: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """((shard, src, j), tables to drop afterwards): the slots of all shards, j the number of a slot among those of its source, which are as many as `count`
    in `sources`.

    Each slot draws its source with the odds of the counts, so a shard's counts are a multinomial draw. Over all shards a source
    is drawn a little more or less often than it should; slots drawn beyond its count go to the sources that lack some."""
    placed = save(running(sources.filter("count > 0"), "src", begin=F.col("count")), "placed")
    total = placed.agg(F.sum("count")).first()[0] or 0
    wide = -(-max(total, 1) // INTERVALS)
    spans = placed.select("src", "begin", "count", F.explode(F.sequence(F.floor(F.col("begin") / wide), F.floor((F.col("begin") + F.col("count") - 1) / wide))).alias("near"))
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1)))
    slots = sources.sparkSession.range(total).select(F.floor(F.col("id") / per_shard).alias("shard"), u.alias("u")).withColumn("near", F.floor(F.col("u") / wide))
    drawn = slots.hint("merge").join(spans.hint("merge"), "near").filter("u >= begin and u < begin + count").groupBy("shard", "src").agg(F.count("*").alias("got"))
    drawn = save(drawn.withColumn("part", F.floor(F.col("shard") / SHARDS)), "drawn")
    sums = drawn.groupBy("src", "part").agg(F.sum("got").alias("sum"))
    start = sums.select("src", "part", F.coalesce(F.sum("sum").over(Window.partitionBy("src").orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("got").over(Window.partitionBy("src", "part").orderBy("shard").rowsBetween(*_BEFORE)), F.lit(0))
    counted = drawn.hint("merge").join(start, ["src", "part"]).withColumn("first", F.col("start") + within)
    all_drawn = placed.join(drawn.groupBy("src").agg(F.sum("got").alias("got")), "src", "left").select("src", "count", F.coalesce("got", F.lit(0)).alias("got"))
    over, under = F.greatest(F.col("got") - F.col("count"), F.lit(0)), F.greatest(F.col("count") - F.col("got"), F.lit(0))
    even = save(running(all_drawn, "src", over=over, under=under), "even")
    j = _by_source(counted.select("shard", "src", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("got") - 1)).alias("j")), even.select("src", "count", "over"), n)
    beyond = j.filter("j >= count").select("shard", (F.col("over") + F.col("j") - F.col("count")).alias("d"))
    lacking = even.filter("got < count").select("src", "got", "under", F.explode(F.sequence(F.col("got"), F.col("count") - 1)).alias("j")).select("src", "j", (F.col("under") + F.col("j") - F.col("got")).alias("d"))
    return j.filter("j < count").select("shard", "src", "j").unionByName(beyond.hint("merge").join(lacking.hint("merge"), "d").select("shard", "src", "j")), [placed, drawn, even]


def plan(docs: DataFrame, block: int = 256, per_shard: int = 256, seed: int = 1, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, text: bool = False) -> Mix:
    """The mix of `docs` (doc_id, source, text): which block of which source stands in which slot of which output shard.

    A source's words, document after document, are cut into blocks of `block` words (its last one may be shorter). Each source
    has as many slots as make up its target to the word: whole passes over its blocks and a part of one more, whose last slot
    is cut short. Slots map to blocks by a permutation for each source and pass, so no block comes a second time before all
    have come once, and none more than `most` times.

    Null and empty texts have no words and are never taken. A null source is a source, the last one; a null doc_id is one like
    any other. Rows that repeat a doc_id are documents of their own. Other columns are ignored. Without words there are no slots.
    The result depends on ids, sources, sizes and `seed` alone, not on partitions.
    """
    rows = numbered(docs, seed, text)
    wanted, n = targets(rows, weights, most)
    size, goal = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    each = wanted.withColumns({"goal": goal, "blocks": F.ceil(size / block), "full": F.floor(size / block)})
    each = each.withColumns({"passes": F.when(size > 0, F.expr("goal div source_size")).otherwise(0), "rest": F.when(size > 0, F.expr("goal % source_size")).otherwise(0)})
    sources = save(each.withColumn("count", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)), "sources")
    dealt, used = _dealt(sources.select("src", "count"), n, per_shard, seed)
    known = _by_source(dealt, sources.select("src", "source_size", "blocks", "full", "passes", "rest"), n)
    placed = known.withColumns({"epoch": F.expr("j div blocks"), "i": F.expr("j % blocks")})
    nth = F.when(F.col("i") < F.col("full"), _permuted("i", "full", F.xxhash64(F.lit(seed), "src", "epoch"))).otherwise(F.col("i"))
    placed = placed.withColumn("block", nth)
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    length = F.when(F.col("epoch") == F.col("passes"), F.least(length, F.col("rest") - F.col("i") * block)).otherwise(length)
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "src", "j"), "src", "j")  # at most per_shard rows each
    slots = save(placed.select("shard", (F.row_number().over(order) - 1).cast("long").alias("slot"), "src", "epoch", "block", length.alias("length")), "slots")
    drop(wanted, *used)
    return Mix(rows, sources, slots, block, n)


def pieces(mix: Mix) -> DataFrame:
    """(shard, slot, offset, src, epoch, block, doc_id, at, start, length[, words]): the mix, a row for each piece of a document in a
    slot, by joining slots and blocks on the block's index. words, if the plan was made with text, are the piece's own."""
    size, text = mix.block, "words" in mix.rows.columns
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("size") - 1) / size)

    def piece(b: Column) -> Column:
        start = F.greatest(b * size - F.col("at"), F.lit(0))
        length = F.least((b + 1) * size - F.col("at"), F.col("size")) - start
        own = [F.slice("words", start.cast("int") + 1, length.cast("int")).alias("words")] if text else []
        return F.struct(b.alias("block"), start.alias("start"), length.alias("length"), F.greatest(F.col("at") - b * size, F.lit(0)).alias("offset"), *own)

    cut = mix.rows.filter("size > 0").select("doc_id", "src", "at", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    blocks = cut.select("doc_id", "src", "at", "p.*")
    joined = mix.slots.withColumnRenamed("length", "room").hint("merge").join(blocks.hint("merge"), ["src", "block"]).filter("offset < room")
    fits = F.least(F.col("length"), F.col("room") - F.col("offset"))
    own = [F.slice("words", F.lit(1), fits.cast("int")).alias("words")] if text else []
    return joined.select("shard", "slot", "offset", "src", "epoch", "block", "doc_id", "at", "start", fits.alias("length"), *own)


def write(mix: Mix, path: str) -> None:
    """The mix as Parquet, range partitions of shards, in order; `mix` is planned with text."""
    pieces(mix).repartitionByRange("shard").sortWithinPartitions("shard", "slot", "offset").select("shard", "slot", "offset", "doc_id", "start", "length", F.array_join("words", " ").alias("text")).write.parquet(path)


def report(mix: Mix) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken), a row for each document: taken counts its words in the mix, each time they come."""
    taken = pieces(mix).groupBy("src", "at").agg(F.sum("length").alias("taken"))
    rows = mix.rows.select("doc_id", "source", "size", "src", F.when(F.col("size") > 0, F.col("at")).alias("at"))
    joined = rows.hint("merge").join(taken.hint("merge"), ["src", "at"], "left").select("doc_id", "source", "size", "src", F.coalesce("taken", F.lit(0)).alias("taken"))
    return _by_source(joined, mix.sources.select("src", "source_size", "target"), mix.n_sources).select("doc_id", "size", "source", "source_size", "target", "taken")


__all__ = ["Mix", "permute_each", "pieces", "plan", "report", "write"]
