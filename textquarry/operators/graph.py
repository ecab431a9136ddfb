"""A graph as one value: nodes and edges with the operators that take both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from textquarry.operators import algorithms, graph_store, recall, search, traversal


@dataclass(frozen=True)
class Graph:
    """Writes return a new Graph; reads return DataFrames."""

    nodes: DataFrame
    edges: DataFrame

    def upsert(self, rows: DataFrame, seq: str = "seq") -> Graph:
        return Graph(graph_store.upsert_nodes(self.nodes, rows, seq), self.edges)

    def connect(self, rows: DataFrame, seq: str = "seq") -> Graph:
        return Graph(self.nodes, graph_store.append_edges(self.edges, rows, seq))

    def delete(self, ids: list[str]) -> Graph:
        return Graph(*graph_store.delete_nodes(self.nodes, self.edges, ids))

    def query(self, q: graph_store.NodeQuery) -> DataFrame:
        return graph_store.query_nodes(self.nodes, q)

    def search(self, phrase: str, k: int) -> DataFrame:
        return search.hybrid_search(self.nodes, phrase, k)

    def recall(self, o: recall.RecallOptions, now: str) -> tuple[DataFrame, Graph]:
        """What is recalled, and the graph in which it counts as read."""
        found, nodes = recall.recall_and_touch(self.nodes, self.edges, o, now)
        return found, Graph(nodes, self.edges)

    def neighbors(self, seeds: DataFrame) -> DataFrame:
        """Neighbours with their summed weights, only those that are nodes."""
        return traversal.neighbors(algorithms.with_ends(self.nodes, self.edges), seeds)

    def related(self, start: str, depth: int) -> DataFrame:
        return traversal.related_nodes(algorithms.with_ends(self.nodes, self.edges), start, depth)

    def path(self, source: str, target: str) -> list[str] | None:
        return algorithms.shortest_path(self.edges, source, target, self.nodes)

    def ranks(self) -> DataFrame:
        return algorithms.pagerank(self.nodes, self.edges)

    def components(self) -> DataFrame:
        return algorithms.components(self.nodes, self.edges)

    def stats(self) -> DataFrame:
        return graph_store.stats(self.nodes, self.edges)
