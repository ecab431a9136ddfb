"""The knowledge graph as two DataFrames: keyed writes, point and range reads, filters, statistics and lifecycle.

Every operator returns new DataFrames; writing them back is the caller's job. Time is a parameter (`now`, ISO text).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = ("id", "type", "title", "body")
NODES = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXTS]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("tags", "projects", "agents")]
    + [T.StructField("created", T.StringType()), T.StructField("updated", T.StringType()), T.StructField("importance", T.DoubleType()), T.StructField("access_count", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("accessed_at", "valid_until", "last_verified")]
)
EDGES = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "source", "target", "relation")] + [T.StructField("weight", T.DoubleType()), T.StructField("ts", T.StringType())])


class Direction(Enum):
    OUT = "out"
    IN = "in"
    BOTH = "both"


def split_list(text: Column | str) -> Column:
    """'a, b,,c' as ['a', 'b', 'c']."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def join_list(items: Column | str) -> Column:
    return F.array_join(items, ",")


def fill_defaults(nodes: DataFrame) -> DataFrame:
    """Older tables lack later columns: they come with their defaults, and nulls become them too."""
    out = nodes
    for f in NODES:
        empty = F.array().cast("array<string>") if isinstance(f.dataType, T.ArrayType) else F.lit({"importance": 0.5, "access_count": 0}.get(f.name, "")).cast(f.dataType)
        out = out.withColumn(f.name, F.coalesce(F.col(f.name), empty) if f.name in nodes.columns else empty)
    return out.select(NODES.fieldNames())


def upsert_nodes(nodes: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert or replace by id in the order of `seq`: created stays that of the first, access_count and accessed_at are the greatest, the rest is the last's."""
    every = nodes.withColumn("_seq", F.lit(-1).cast("long")).unionByName(rows.select(*nodes.columns, F.col(seq).cast("long").alias("_seq")))
    last = [c for c in nodes.columns if c not in ("id", "created", "access_count", "accessed_at")]
    merged = every.groupBy("id").agg(
        F.min_by("created", "_seq").alias("created"), F.max("access_count").alias("access_count"), F.max("accessed_at").alias("accessed_at"), F.max_by(F.struct(*last), "_seq").alias("_last")
    )
    return merged.select("id", "created", "access_count", "accessed_at", "_last.*").select(nodes.columns)


def append_edges(edges: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Add edges whose id is new and whose (source, target, relation) is new; among the new ones the first by `seq` counts."""
    triple = ["source", "target", "relation"]
    new = rows.select(*edges.columns, F.col(seq).alias("_seq"))
    new = new.join(edges.select("id"), "id", "left_anti").join(edges.select(triple), triple, "left_anti")
    for keys in (["id"], triple):
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_seq"))).filter("_n = 1").drop("_n")
    return edges.unionByName(new.select(edges.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Without these nodes and the edges that touch them."""
    return nodes.filter(~F.col("id").isin(ids)), edges.filter(~(F.col("source").isin(ids) | F.col("target").isin(ids)))


def delete_edges(edges: DataFrame, ids: list[str]) -> DataFrame:
    return edges.filter(~F.col("id").isin(ids))


def read_nodes(nodes: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """The nodes of these ids; an empty list gives none. A DataFrame of ids is joined, a short list is a filter."""
    if isinstance(ids, list):
        return nodes.filter(F.col("id").isin(ids))
    return nodes.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")


def latest_nodes(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy(F.desc("updated"), "id").limit(n)


def edges_among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in `ids`."""
    some = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    return edges.join(some, edges.source == some["_id"], "left_semi").join(some.withColumnRenamed("_id", "_t"), F.col("target") == F.col("_t"), "left_semi")


def edges_of(edges: DataFrame, node: str, direction: Direction = Direction.BOTH, relation: str | None = None) -> DataFrame:
    """A node's edges, heaviest first."""
    ends = {Direction.OUT: F.col("source") == node, Direction.IN: F.col("target") == node, Direction.BOTH: (F.col("source") == node) | (F.col("target") == node)}
    found = edges.filter(ends[direction])
    return (found if relation is None else found.filter(F.col("relation") == relation)).orderBy(F.desc("weight"), "id")


def snapshot(nodes: DataFrame, edges: DataFrame, most_edges: int | None = 2_000) -> tuple[DataFrame, DataFrame]:
    """Node summaries and edges, up to `most_edges` of them by id (a feature of the snapshot; None for all)."""
    some = edges if most_edges is None else edges.orderBy("id").limit(most_edges)
    return nodes.select("id", "type", "title", "tags", "projects", "importance", "updated"), some


@dataclass
class NodeQuery:
    tag: str | None = None
    type: str | None = None
    project: str | None = None
    since: str | None = None
    until: str | None = None
    order: str = "created_desc"
    limit: int = 50
    offset: int = 0
    any_tags: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)


_ORDERS = {"created_desc": F.desc, "created_asc": F.asc, "updated_desc": F.desc, "importance_desc": F.desc}


def has_item(column: str, value: str, any_case: bool = False) -> Column:
    """Membership in a list column; any_case compares in lower case."""
    return F.exists(column, lambda x: F.lower(x) == value.lower()) if any_case else F.array_contains(column, value)


def in_scope(q: NodeQuery, any_case: bool = False) -> Column:
    """All conditions of the query but order and limits: since is inclusive, until exclusive, on created."""
    tests = [F.lit(True)]
    if q.tag is not None:
        tests.append(has_item("tags", q.tag, any_case))
    if q.type is not None:
        tests.append(F.col("type") == q.type)
    if q.project is not None:
        tests.append(has_item("projects", q.project, any_case))
    if q.since is not None:
        tests.append(F.col("created") >= q.since)
    if q.until is not None:
        tests.append(F.col("created") < q.until)
    if q.any_tags:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, q.any_tags))))
    if q.types:
        tests.append(F.col("type").isin(q.types))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def query_nodes(nodes: DataFrame, q: NodeQuery, most: int = 200) -> DataFrame:
    """The nodes of a query, ordered, offset and limited (200 at most), ties by id."""
    by = _ORDERS[q.order](q.order.rsplit("_", 1)[0])
    return nodes.filter(in_scope(q)).orderBy(by, "id").offset(q.offset).limit(min(q.limit, most))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average importance to 2 places, and a map of nodes by type."""
    by_type = nodes.groupBy("type").agg(F.count("*").alias("n"), F.sum("importance").alias("s"))
    total = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.round(F.sum("s") / F.sum("n"), 2), F.lit(0.0)).alias("avg_importance"), F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("by_type"))
    return total.join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each


# lifecycle


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(text: Column | str) -> Column:
    """Seconds of an ISO text by its fixed places, zone ignored; 0 where it is too short or no time."""
    t = F.col(text) if isinstance(text, str) else text
    part = F.concat(F.substring(t, 1, 10), F.lit(" "), F.substring(t, 12, 8))
    return F.when(F.length(t) >= 19, F.coalesce(F.unix_timestamp(F.try_to_timestamp(part, F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0))).otherwise(F.lit(0)).cast("long")


def before(now: str, days: float = 0, hours: float = 0) -> str:
    """ISO text so long before `now`."""
    from datetime import datetime, timedelta

    return (datetime.fromisoformat(now[:19]) - timedelta(days=days, hours=hours)).strftime("%Y-%m-%dT%H:%M:%SZ")


def touch(nodes: DataFrame, ids: list[str], now: str) -> DataFrame:
    hit = F.col("id").isin(ids)
    return nodes.withColumns({"access_count": F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count")), "accessed_at": F.when(hit, now).otherwise(F.col("accessed_at"))})


def mark_verified(nodes: DataFrame, node: str, now: str) -> DataFrame:
    return nodes.withColumn("last_verified", F.when(F.col("id") == node, now).otherwise(F.col("last_verified")))


def decays(days: float, floor: float, now: str) -> Column:
    cutoff = before(now, days=days)
    return ((F.col("accessed_at") < cutoff) | (F.col("accessed_at") == "")) & (F.col("updated") < cutoff) & (F.col("importance") > floor) & ~F.array_contains("tags", "pinned")


def decay_importance(nodes: DataFrame, days: float, factor: float, floor: float, now: str) -> DataFrame:
    """Importance times `factor`, not below `floor`, of nodes neither read nor changed for `days` and not pinned; those are decays()."""
    return nodes.withColumn("importance", F.when(decays(days, floor, now), F.greatest(F.lit(floor), F.col("importance") * factor)).otherwise(F.col("importance")))


def tag_stale(nodes: DataFrame, days: float, now: str) -> DataFrame:
    due = (F.col("updated") < before(now, days=days)) & ~F.array_contains("tags", "stale")
    return nodes.withColumn("tags", F.when(due, F.array_append("tags", F.lit("stale"))).otherwise(F.col("tags")))


def expired(nodes: DataFrame, now: str) -> DataFrame:
    return nodes.filter((F.col("valid_until") != "") & (F.col("valid_until") < now))


def duplicates(nodes: DataFrame, rows: DataFrame, hours: float, now: str) -> DataFrame:
    """(title, id): for titles of `rows` the node of that title updated last, if within the last `hours`."""
    recent = nodes.filter(F.col("updated") > before(now, hours=hours))
    return recent.join(rows.select("title").distinct(), "title", "left_semi").groupBy("title").agg(F.max_by("id", F.struct("updated", "id")).alias("id"))


def upsert_dedup(nodes: DataFrame, rows: DataFrame, hours: float, now: str, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(nodes, outcome): rows whose title stands in a recent node leave that untouched; outcome is (id, was_duplicate) a row."""
    known = duplicates(nodes, rows, hours, now).withColumnRenamed("id", "_old")
    judged = rows.join(known, "title", "left")
    return upsert_nodes(nodes, judged.filter("_old is null").drop("_old"), seq), judged.select(F.coalesce("_old", "id").alias("id"), F.col("_old").isNotNull().alias("was_duplicate"))


# keyed values


def kv_put(store: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, value), the last by `seq` wins."""
    every = store.select("key", "value", F.lit(-1).cast("long").alias("seq")).unionByName(rows.select("key", "value", F.col("seq").cast("long")))
    return every.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def kv_get(store: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value) of the keys that are there."""
    return store.filter(F.col("key").isin(keys)).select("key", "value")


def kv_delete(store: DataFrame, keys: list[str]) -> DataFrame:
    return store.filter(~F.col("key").isin(keys))
