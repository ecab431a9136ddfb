"""N-gram Jaccard join by grouped prefixes: classes of documents that links of a given similarity connect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import arrow_rows, bit_table, components, drop, may_hold, save, without
from textquarry.llm.shingles import mix, shingle_sets

#: A shingle counts as common where a block of BLOCK shingles of one task holds it LOCAL times; of those, the COMMON_ROWS
#: with the highest sums (16 bytes each) are told to the tasks that order shingles. The order only decides how many
#: candidates there are, never which links are found, so what this table misses costs time and no result.
BLOCK, LOCAL, COMMON_ROWS = 2_000_000, 3, 1_000_000


#: Bits of a signature at least; a larger set has as many as the power of two that reaches its size.
SIGNATURE_BITS = 1_024

#: Parts that the rows of a bucket are dealt to where they meet those of other components.
SALTS = 8

#: Texts that are handed to Python at a time.
TEXTS = 1_000


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles that many documents share, from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(sets: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_pydict({"h": h[n >= LOCAL].astype(np.int64), "n": n[n >= LOCAL]})

        held, size = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield often(held)
                    held, size = [], 0
        if size:
            yield often(held)

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "h").limit(COMMON_ROWS).toArrow()
    h, n = top.column("h").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.int64)


def profiles(docs: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, s1, s2, sig, prefix): a document's set size, two checksums of the set, its signature, and its prefix:
    the n - ceil(t*n) + 1 least common shingles. Two sets of similarity t or more share one of their prefixes' shingles.
    A signature's bit says whether an odd number of shingles hash to it, so sets differ in at least as many shingles as
    their signatures do in bits."""
    table = docs.sparkSession.sparkContext.broadcast(common)  # COMMON_ROWS pairs at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = table.value

        def rank(x: np.ndarray) -> np.ndarray:
            if not len(hashes):
                return np.zeros(len(x), np.int64)
            at = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
            return np.where(hashes[at] == x, counts[at], 0)

        for batch in batches:
            n, s1, s2, sig, prefix = [], [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                p = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                n.append(len(s))
                with np.errstate(over="ignore"):
                    s1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    s2.append(int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).astype(np.int64)))
                bits = max(SIGNATURE_BITS, 1 << max(len(s) - 1, 0).bit_length())
                odd = np.bincount((mix(s + np.uint64(0x51)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                sig.append(np.packbits(odd.astype(bool)).view(np.int64))
                prefix.append(s[np.argsort(rank(s), kind="stable")[:p]].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "n", "s1", "s2", "sig", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sig array<long>, prefix array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents in `ids`, and of others that a fixed table of bits can't tell from them: texts
    stay where they are, and only these sets go to the join that decides."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(ids, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.filter(pa.array(may_hold(table.value, batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False))))
            for i in range(0, near.num_rows, 512):
                part = near.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype(np.int64) for s in shingle_sets(part.column(1), width)], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, shingles array<long>")


def differing_bits(a: Column, b: Column) -> Column:
    """Of two signatures, the longer one folded once onto the shorter; 0 where their lengths still differ."""

    def folded(x: Column, other: Column) -> Column:
        k = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    x, y = folded(a, b), folded(b, a)
    total = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)
    return F.when(F.size(x) == F.size(y), total).otherwise(0)


def verify(docs: DataFrame, own: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets really are that similar: those that their signatures can't rule out, by their sets."""
    one = lambda c: own.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    differ = differing_bits(F.col("sig_a"), F.col("sig_b"))
    most = (F.col("n_a") + F.col("n_b") - differ) / 2  # of common shingles
    # merge: pairs grow with the input, so the joins that hold for many of them are asked for at every size
    pairs = one("a").hint("merge").join(pairs, "a").join(one("b").hint("merge"), "b").filter(most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    pairs = save(pairs.select("a", "b").distinct(), "pairs")
    left = sets_of(docs, pairs.select(F.col("a").alias("doc_id")), width).select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets_of(docs, pairs.select(F.col("b").alias("doc_id")), width).select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = left.join(pairs.hint("merge"), "a").join(right.hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    similar = both.filter(common * 100 >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()
    with arrow_rows(docs.sparkSession, TEXTS):
        links = save(similar, "links")
    drop(pairs)
    return links


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Class of every document: (doc_id, n_shingles, component_id).

    Sets are the distinct runs of `width` words (A-Z lower-cased, white space between) of the whole text, or the whole
    sequence where there are fewer; documents link where 100 * intersection >= percent * union, and component_id is
    the smallest doc_id that links reach. Null and empty texts have no shingles, link with nothing, and are their own
    component. Rows that repeat a doc_id count as one document with several texts.

    Equal sets collapse into one class first (an aggregate, so thousands of copies cost a row each). Classes with the
    same size and prefix form a group. In each prefix shingle's bucket the groups are paired with one leader, the group
    with most of its prefix shared, which joins a cluster of near copies at a few rows a document. Then every pair of
    groups that passes the size and position filters and still lies across two components is expanded to its members
    and verified, so no link between components is lost.
    """
    with arrow_rows(docs.sparkSession, TEXTS):
        own = save(profiles(docs, width, percent, common_shingles(docs, width)), "profiles")
    some = own.filter("n > 0").select("doc_id", "n", "s1", "s2", F.xxhash64("prefix").alias("p"))
    equals = some.groupBy("n", "s1", "s2", "p").agg(F.min("doc_id").alias("rep"))
    groups = equals.groupBy("n", "p").agg(F.min("rep").alias("gid"))
    members = save(some.join(equals, ["n", "s1", "s2", "p"]).select("doc_id", "rep", "n", "p"), "members")
    grouped = save(equals.select("rep", "n", "p").distinct().join(groups, ["n", "p"]).select("gid", "rep").distinct(), "groups")
    equal = members.filter("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    following = members.filter("doc_id <> rep").select("doc_id").unionByName(grouped.filter("rep <> gid").select(F.col("rep").alias("doc_id"))).distinct()
    leading = without(own.filter("n > 0"), following)

    shared = save(_shared_tokens(leading.dropDuplicates(["doc_id", "n", "s1", "s2"]).select(F.col("doc_id").alias("gid"), "n", "prefix"), percent), "tokens")
    inside = grouped.filter("rep <> gid").select(F.col("rep").alias("a"), F.col("gid").alias("b"))
    links = verify(docs, own, _leaders(shared, percent).unionByName(inside).distinct(), width, percent)
    of = components(links, "a", "b")
    placed = save(grouped.join(of, F.col("rep") == F.col("node"), "left").select("gid", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    left = verify(docs, own, _across(placed, shared, percent), width, percent)
    drop(shared, placed)
    everything = equal.unionByName(links.unionByName(left).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    result = components(everything)
    drop(members, grouped)
    return own.join(result, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _may_link(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """Size filter, and position filter for a first common shingle at places at1 and at2 of the prefixes; n1 <= n2."""
    need = F.ceil((n1 + n2) * percent / F.lit(100 + percent) - 1e-9)
    return (n1 * 100 >= n2 * percent) & (F.least(n1 - at1, n2 - at2) >= need)


def _shared_tokens(groups: DataFrame, percent: int) -> DataFrame:
    """(token, gid, n, at, own_tokens) of prefix shingles that a group of a fitting size shares: next to it in size order."""
    w = Window.partitionBy("token").orderBy("n", "gid")
    tokens = groups.select("gid", "n", F.size("prefix").alias("own_tokens"), F.posexplode("prefix").alias("at", "token"))
    near = tokens.withColumns({"before": F.lag("n").over(w), "after": F.lead("n").over(w)})
    return near.filter((F.col("before") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("after") * percent)).drop("before", "after")


def _leaders(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): each group with the leader of each of its buckets. A cluster's original shares all of its prefix, while an
    edited copy has shingles of its own, so the leader is likely to link with every copy."""
    lonely = shared.groupBy("gid").agg((1 - F.count("*") / F.max("own_tokens")).alias("lonely"))
    known = shared.hint("merge").join(lonely, "gid")
    leads = known.groupBy("token").agg(F.min(F.struct("lonely", "gid", "n", "at")).alias("lead"))
    led = known.hint("merge").join(leads, "token").filter("gid <> lead.gid")
    n, at, m, to = F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")
    fits = F.when(n <= m, _may_link(n, at, m, to, percent)).otherwise(_may_link(m, to, n, at, percent))
    return led.filter(fits).select(F.col("gid").alias("a"), F.col("lead.gid").alias("b")).distinct()


def _across(placed: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of members that may link and lie in different components."""
    span = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    # A group within one component goes by that; one that spans several is apart from all others, and goes by its own id.
    one = F.col("low") == F.col("high")
    side = F.struct((~one).alias("mixed"), F.when(one, F.col("low")).otherwise(F.col("gid")).alias("of"))
    rows = shared.hint("merge").join(span, "gid").select("token", "gid", "n", "at", side.alias("side"))
    # Most buckets lie within one component by now and are left at the cost of an aggregate, whatever their size.
    several = rows.groupBy("token").agg(F.min("side").alias("least"), F.max("side").alias("most")).filter("least < most").select("token")
    rows = save(rows.hint("merge").join(several.hint("merge"), "token").withColumn("salt", F.pmod(F.xxhash64("gid"), F.lit(SALTS))), "apart")
    # Rows meet the bounds of the other components first, then only the rows of those they may link with; a hot bucket's
    # or component's rows are dealt to SALTS parts, for which the other side is copied.
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    bounds = rows.groupBy("token", "side").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("at")).alias("left"))
    bounds = bounds.select("token", F.col("side").alias("to"), "least_n", "most_n", "left", salts)
    need = F.ceil((F.col("n") + F.col("least_n")) * percent / F.lit(100 + percent) - 1e-9)
    fits = (F.col("n") * 100 >= F.col("least_n") * percent) & (F.col("most_n") * 100 >= F.col("n") * percent) & (F.least(F.col("n") - F.col("at"), F.col("left")) >= need)
    near = rows.hint("merge").join(bounds.hint("merge"), ["token", "salt"]).filter(F.col("side") < F.col("to")).filter(fits).select("token", F.col("gid").alias("ga"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("to").alias("side"), salts)
    met = near.hint("merge").join(rows.hint("merge"), ["token", "side", "salt"])
    n, at, m, to = F.col("n_a"), F.col("at_a"), F.col("n"), F.col("at")
    met = met.filter(F.when(n <= m, _may_link(n, at, m, to, percent)).otherwise(_may_link(m, to, n, at, percent)))
    pairs = met.select("ga", F.col("gid").alias("gb")).unionByName(span.filter("low <> high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))).distinct()
    a = placed.select(F.col("gid").alias("ga"), F.col("rep").alias("a"), F.col("component").alias("ca"))
    b = placed.select(F.col("gid").alias("gb"), F.col("rep").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "ga").join(b, "gb").filter((F.col("ca") != F.col("cb")) & ((F.col("ga") != F.col("gb")) | (F.col("a") < F.col("b")))).select("a", "b").distinct()
