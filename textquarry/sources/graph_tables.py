"""The knowledge graph in versioned tables: writes that last, see each other and can be undone by reading an older version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.graph import Graph
from textquarry.operators.graph_store import EDGES, NODES, Direction, append_edges, fill_defaults, upsert_nodes
from textquarry.plans.rounds import cut, drop
from textquarry.sources.versioned import Store, Transaction

#: What the schema of each version added to the first one.
_USE, _VALIDITY = ("agents", "access_count", "accessed_at"), ("valid_until", "last_verified")


def _with_columns(t: Transaction, names: tuple[str, ...]) -> None:
    have = [f["name"] for f in t.entry("nodes")["columns"]["fields"]]
    if all(n in have for n in names):
        return
    new = T.StructType([NODES[n] for n in names if n not in have])
    defaults = {f.name: "[]" if isinstance(f.dataType, T.ArrayType) else 0 if isinstance(f.dataType, T.LongType) else "" for f in new}
    t.add_columns("nodes", new, defaults, [f.name for f in NODES if f.name in have or f.name in names])


def _edges_by_target(t: Transaction) -> None:
    entry = t.entry("edges")
    t.write("edges_by_target", t.read("edges"), "target", entry["buckets"])


#: What an upsert takes from the row that it replaces.
_KEPT = ("created", "access_count", "accessed_at")
#: Schema versions: 2 counts how nodes are used, 3 finds edges by their target, 4 says until when nodes hold.
STEPS = [(1, lambda t: None), (2, lambda t: _with_columns(t, _USE)), (3, _edges_by_target), (4, lambda t: _with_columns(t, _VALIDITY))]
SCHEMA = STEPS[-1][0]


class GraphTables:
    """A graph in a folder. Every write is one commit over all its tables and rewrites only the buckets it touches; writers
    that meet in a bucket go one after the other, by trying again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    @classmethod
    def create(cls, nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 64, wide: bool = False) -> GraphTables:
        """A new graph of the newest schema; an error where the folder already has one. wide: nodes have long texts, which are not
        shuffled then; each task writes files of its own."""
        made = cls(nodes.sparkSession, path)

        def fill(t: Transaction) -> None:
            if t.base["tables"]:
                raise ValueError(f"{path} already holds tables")
            t.write("nodes", fill_defaults(nodes), "id", buckets, shuffle=not wide)
            t.write("edges", edges.select(EDGES.fieldNames()), "source", buckets)
            t.write("edges_by_target", edges.select(EDGES.fieldNames()), "target", buckets)
            t.schema = SCHEMA

        made.store.run(fill)
        return made

    def migrate(self) -> int:
        """Bring tables of an older schema to the newest."""
        return self.store.migrate(STEPS)

    def graph(self, version: int | None = None) -> Graph:
        """The graph as of a version, with all its operators."""
        return Graph(fill_defaults(self.store.read("nodes", version)), self.store.read("edges", version))

    def nodes_of(self, ids: list[str], version: int | None = None) -> DataFrame:
        """The nodes of a few ids; reads their buckets only."""
        return self.store.read("nodes", version, ids)

    def edges_of(self, ids: list[str], direction: Direction = Direction.BOTH, version: int | None = None) -> DataFrame:
        """The edges of a few nodes; reads the buckets of their sources, of their targets, or both."""
        out, into = self.store.read("edges", version, ids), self.store.read("edges_by_target", version, ids)
        return {Direction.OUT: out, Direction.IN: into, Direction.BOTH: out.unionByName(into).dropDuplicates(["id"])}[direction]

    def upsert(self, rows: DataFrame, seq: str = "seq", wide: bool = False) -> int:
        """graph_store.upsert_nodes() over the nodes' buckets; `wide` as in create(). Returns the version."""
        first = rows.filter(F.col(seq).isNull() | (F.col(seq).cast("long") < 0)).head(1)  # those don't replace what is there

        def put(old: DataFrame, new: DataFrame) -> DataFrame:
            if first:
                return upsert_nodes(old, new, seq)
            ids = new.select("id").distinct()
            there = old.select("id", *_KEPT).join(ids, "id", "left_semi")  # of a row that is replaced no more than these counts
            merged = upsert_nodes(there.select(*(c if c in ("id", *_KEPT) else F.lit(None).cast(t).alias(c) for c, t in old.dtypes)), new, seq)
            return old.join(ids, "id", "left_anti").select(old.columns).unionByName(merged)

        return self.store.run(lambda t: t.merge("nodes", rows, put, shuffle=not wide))

    def connect(self, rows: DataFrame, seq: str = "seq") -> int:
        """graph_store.append_edges(): new edges are put beside those that are there; of these only the ids, and the buckets of the
        same sources, are read. Two writers at a time that give one id to edges of different buckets both succeed."""

        def add(t: Transaction) -> None:
            edges = t.read("edges")
            fresh = rows.join(edges.select("id"), "id", "left_anti")
            near = edges.join(rows.select("source").distinct(), "source", "left_semi").select(edges.columns)
            new = cut(append_edges(near, fresh, seq).join(near.select("id"), "id", "left_anti").select(edges.columns), "edges")
            t.append("edges", new, reads=rows)
            t.append("edges_by_target", new)
            drop(new)

        return self.store.run(add)

    def delete(self, ids: DataFrame | list[str]) -> int:
        """Without these nodes and the edges that touch them, in one commit."""
        gone = self.spark.createDataFrame([(i,) for i in ids], T.StructType([NODES["id"]])) if isinstance(ids, list) else ids.select(F.col(ids.columns[0]).alias("id")).distinct()

        def without(t: Transaction) -> None:
            touching = t.read("edges").join(gone.select(F.col("id").alias("source")), "source", "left_semi").select(EDGES.fieldNames())
            touching = touching.unionByName(t.read("edges_by_target").join(gone.select(F.col("id").alias("target")), "target", "left_semi").select(EDGES.fieldNames()))
            dead = cut(touching.dropDuplicates(["id"]), "dead")
            there = t.read("nodes").select("id").join(gone, "id", "left_semi")  # other buckets stay as they are
            t.merge("nodes", gone, lambda old, new: old.join(new, "id", "left_anti"), keys=there, shuffle=False)
            for table in ("edges", "edges_by_target"):
                t.merge(table, dead, lambda old, new: old.join(new.select("id"), "id", "left_anti"), shuffle=False)
            drop(dead)

        return self.store.run(without)


__all__ = ["SCHEMA", "STEPS", "GraphTables"]
