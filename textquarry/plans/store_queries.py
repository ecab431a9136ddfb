"""Registered queries of the operators that keep tables in folders: versioned graphs, migrations, the phrase index."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.functions import sql
from textquarry.operators import graph_store as g
from textquarry.operators.phrase_index import PhraseIndex
from textquarry.operators import search, vectors
from textquarry.operators.snapshot import Snapshot
from textquarry.operators.vector_index import CellIndex, Quantised
from textquarry.plans.more_queries import _HAND_OVERS, hand_overs
from textquarry.streaming import guard, stateful
from textquarry.plans.queries import ORACLES, _COS, _NORM, LISTS_SQL, NODES_SQL, SUPPLIES_SQL, _bm25_sql, converged_sql, lists, nodes, query, read, supplies
from textquarry.plans.rounds import cut, folder
from textquarry.sources import sqlite
from textquarry.sources.graph_tables import GraphTables


def _anew(spark, what: str) -> str:
    """A folder of its own in the shared one, deleted when the driver ends."""
    return folder(spark, f"{what}-{uuid.uuid4().hex}")


_HITS = "SELECT id, round(bm25, 6) AS bm25 FROM hits ORDER BY hits.bm25, importance DESC, id LIMIT 50"


@query(f"{_bm25_sql('license')} {_HITS}")
def indexed_top(spark, sf_dir):
    """Phrase search over the index of all nodes."""
    index = PhraseIndex.build(nodes(spark, sf_dir), _anew(spark, "phrases"))
    return index.search("license", 50).select("id", F.round("bm25", 6).alias("bm25"))


_CHANGED = """nodes AS (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 'the license again, ' || body ELSE body END AS body) FROM all_nodes WHERE CAST(id AS BIGINT) % 10 <> 1)"""


@query(_bm25_sql("license").replace("nodes AS (SELECT", "all_nodes AS (SELECT", 1).replace("FROM documents)", f"FROM documents), {_CHANGED}", 1) + f" {_HITS}")
def reindexed_top(spark, sf_dir):
    """The same after a tenth of the nodes got a new body and a tenth was deleted."""
    every = nodes(spark, sf_dir)
    index = PhraseIndex.build(every, _anew(spark, "phrases"))
    index.upsert(every.filter("cast(id as bigint) % 10 = 0").withColumn("body", F.concat(F.lit("the license again, "), "body")))
    index.delete(every.filter("cast(id as bigint) % 10 = 1").select("id"))
    return index.search("license", 50).select("id", F.round("bm25", 6).alias("bm25"))


@query(
    f"""WITH {NODES_SQL}, {SUPPLIES_SQL}, late AS (SELECT * REPLACE ('new' AS title, access_count + 5 AS access_count) FROM nodes WHERE CAST(id AS BIGINT) % 7 = 0),
    two AS (SELECT id, title, access_count FROM nodes WHERE id NOT IN (SELECT id FROM late) UNION ALL SELECT id, title, access_count FROM late),
    gone AS (SELECT source AS id FROM edges WHERE source < 's2')
    SELECT 1 AS version, 'node' AS kind, id, title, access_count FROM nodes UNION ALL SELECT 3, 'node', id, title, access_count FROM two
    UNION ALL SELECT 1, 'edge', id, relation, NULL FROM edges UNION ALL SELECT 3, 'edge', id, relation, NULL FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)"""
)
def graph_versions(spark, sf_dir):
    """A graph of two commits after its first one, read as it was and as it is."""
    every, edges = nodes(spark, sf_dir), supplies(spark, sf_dir)
    edges = cut(edges, "supplies")
    graph = GraphTables.create(every, edges, _anew(spark, "graph"), 16, wide=True)
    late = every.filter("cast(id as bigint) % 7 = 0").withColumns({"title": F.lit("new"), "access_count": F.col("access_count") + 5, "seq": F.lit(0)})
    graph.upsert(late, wide=True)
    graph.delete(edges.filter("source < 's2'").select(F.col("source").alias("id")).distinct())
    out = None
    for version in (1, 3):
        at = graph.graph(version)
        one = at.nodes.select(F.lit(version).alias("version"), F.lit("node").alias("kind"), "id", "title", "access_count").unionByName(
            at.edges.select(F.lit(version).alias("version"), F.lit("edge").alias("kind"), "id", F.col("relation").alias("title"), F.lit(None).cast("long").alias("access_count"))
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SUPPLIES_SQL} SELECT target, count(*) AS edges, CAST(4 AS INTEGER) AS schema FROM edges GROUP BY target")
def migrated_graph(spark, sf_dir):
    """A graph of the first schema, brought to the newest: edges are found by their target then."""
    graph = GraphTables(spark, _anew(spark, "graph"))
    t = graph.store.begin()
    t.write("nodes", nodes(spark, sf_dir).select("id", "type", "title", "body", "tags", "projects", "created", "updated", "importance"), "id", 16, shuffle=False)
    t.write("edges", supplies(spark, sf_dir), "source", 16)
    t.schema = 1
    t.commit()
    schema = graph.migrate()
    return graph.store.read("edges_by_target").groupBy("target").agg(F.count("*").alias("edges")).withColumn("schema", F.lit(schema))


_ROWS = "SELECT id, source, target FROM edges WHERE source IN ('s1', 's7') OR target IN ('s1', 's7', 'p3')"


@query(f"WITH {SUPPLIES_SQL} {_ROWS} UNION ALL SELECT 'new', 's1', 'p-new'")
def connected_graph(spark, sf_dir):
    """Edges of a few nodes after a commit that adds one, read from the buckets of their ends."""
    edges = supplies(spark, sf_dir)
    graph = GraphTables.create(nodes(spark, sf_dir), edges, _anew(spark, "graph"), 16)
    graph.connect(spark.range(1).select(F.lit("new").alias("id"), F.lit("s1").alias("source"), F.lit("p-new").alias("target"), F.lit("supplies").alias("relation"), F.lit(1.0).alias("weight"), F.lit("").alias("ts"), F.lit(0).alias("seq")))
    out, into = graph.edges_of(["s1", "s7"], g.Direction.OUT), graph.edges_of(["s1", "s7", "p3"], g.Direction.IN)
    return out.unionByName(into).select("id", "source", "target").dropDuplicates(["id"])


_LABELS = f"""WITH RECURSIVE {_HAND_OVERS}, node AS (SELECT id, row_number() OVER (ORDER BY CAST(substr(id, 2) AS BIGINT)) AS i FROM ids),
ends AS (SELECT a.i AS a, b.i AS b, weight FROM edges JOIN node a ON a.id = source JOIN node b ON b.id = target),
near AS (SELECT a, list({{'b': b, 'w': weight}}) AS ns FROM (SELECT a, b, weight FROM ends UNION ALL SELECT b, a, weight FROM ends) GROUP BY a),
f AS (SELECT (SELECT list(i ORDER BY i) FROM node) AS lab, 0::BIGINT AS t UNION ALL
  SELECT CASE WHEN ns IS NULL THEN lab ELSE lab[1:i - 1] || [list_sort(list_transform(list_distinct(list_transform(ns, lambda x: lab[x.b])), lambda c: {{'s': -list_sum(list_transform(ns, lambda y: CASE WHEN lab[y.b] = c THEN y.w ELSE 0 END)), 'c': c}}))[1].c] || lab[i + 1:] END, t + 1
  FROM (SELECT *, t % len(lab) + 1 AS i FROM f WHERE t < 10 * len(lab)) LEFT JOIN near ON near.a = i)
SELECT n.id, m.id AS label FROM (SELECT unnest(range(1, len(lab) + 1)) AS i, unnest(lab) AS l FROM f WHERE t = 10 * len(lab)) JOIN node n USING (i) JOIN node m ON m.i = l"""


@query(_LABELS)
def hand_over_labels(spark, sf_dir):
    """Label propagation on a graph with cycles, loops and hubs."""
    ids = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("pos"))
    s = Snapshot.build(ids, hand_overs(spark, sf_dir), "pos")
    out = cut(s.named(s.label_propagation().withColumnRenamed("idx", "id"), "id", "label"), "labels")
    s.drop()
    return out


@query(converged_sql(_HAND_OVERS, 30) + ", c AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM edges WHERE source <> target) THEN (SELECT min(id) FROM ids) END AS component) SELECT id, round(r / sum(r) OVER (), 8) AS rank, component FROM every JOIN chosen USING (k), c")
def one_snapshot(spark, sf_dir):
    """Ranks and components of one snapshot; the suppliers are all connected."""
    ids = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    s = Snapshot.build(ids, hand_overs(spark, sf_dir))
    both = s.pagerank().join(s.components(), "idx").withColumnRenamed("idx", "id")
    out = cut(s.named(both, "id", "component").select("id", F.round("rank", 8).alias("rank"), "component"), "ranks")
    s.drop()
    return out


@query(f"SELECT q.vec_id AS query_id, a.vec_id AS id, round({_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, a.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings a WHERE q.vec_id <> a.vec_id QUALIFY rank <= 3")
def nearest_of_all(spark, sf_dir):
    """The three nearest others of every vector: a join of two tables that both grow."""
    e = read(spark, sf_dir, "embeddings")
    index = CellIndex.build(e, _anew(spark, "cells"), id_="vec_id", vector="embedding")
    got = index.knn(e.withColumnRenamed("vec_id", "query_id"), 3, vector="embedding", skip_self=True)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("SELECT CAST(vec_id AS BIGINT) AS query_id, 4 AS bits, 32 AS bytes_a_vector, true AS recall_ok FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT CAST(vec_id AS BIGINT), 2, 16, true FROM embeddings WHERE vec_id % 50 = 0")
def quantised_recall(spark, sf_dir):
    """For both widths of codes: whether at least 0.9 of the ten nearest of all stated queries are found; a row for each query."""
    e = read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = cut(vectors.knn(e, q, 10, id_="vec_id", vector="embedding").select("query_id", "id"), "exact")
    out = None
    for bits in (4, 2):
        index = Quantised.build(e, bits, id_="vec_id", vector="embedding")
        hits = index.search(e, q, 10, id_="vec_id", vector="embedding").select("query_id", "id", F.lit(1).alias("hit"))
        each = exact.join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
        share = each.agg((F.sum("found") / F.sum("n")).alias("recall"))  # one row
        one = each.join(F.broadcast(share)).select("query_id", F.lit(bits).alias("bits"), F.lit(index.bytes_a_vector).alias("bytes_a_vector"), (F.col("recall") >= 0.9).alias("recall_ok"))
        out = one if out is None else out.unionByName(one)
    return out


def _streamed(spark, rows, by, n: int, flow, what: str):
    """What the stream `flow` gives for `rows` in n batches, in the order of the column `by`, whose values divide them. Each batch is
    written by many tasks, in any number of files, and taken whole by a run that goes on from the state of the one before."""
    path, out = _anew(spark, what), None
    for i in range(n):
        rows.filter(by == i).write.parquet(f"{path}/in/b{i}")
        if out is None:
            out = flow(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/in"))
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth, event_type || 'é😀' AS content FROM events")
def chunked_stream(spark, sf_dir):
    """Each user's events as one byte stream that comes in chunks of 11 bytes, in three batches: lines and characters are cut anywhere."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit('data: {"choices": [{"delta": {"content": "'), "event_type", F.lit('é😀"}}]}\n\n')).alias("line"))
    body = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "").cast("binary").alias("all"))
    n = F.ceil(F.octet_length("all") / 11).cast("int")
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("all", i * 11 + 1, F.lit(11)))).alias("seq", "bytes")
    chunks = cut(body.select(F.col("user_id").alias("stream_id"), n.alias("n"), pieces), "chunks")
    parts = chunks.withColumn("part", F.floor(F.col("seq") * 3 / F.col("n")))
    got = _streamed(spark, parts, F.col("part"), 3, lambda live: guard.decode_events(stateful.lines(live)), "chunked")
    w = Window.partitionBy("stream_id").orderBy("nth")
    return got.select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("nth"), "content")


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id * 10 AS updated FROM events),
f AS (SELECT user_id, event_id, i, true AS kept, event_id AS last, updated AS at FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, f.at <= e.event_id * 10 - 5000, CASE WHEN f.at <= e.event_id * 10 - 5000 THEN e.event_id ELSE f.last END, CASE WHEN f.at <= e.event_id * 10 - 5000 THEN e.updated ELSE f.at END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT CAST(event_id AS VARCHAR) AS id, kept, CAST(last AS VARCHAR) AS survivor FROM f""")
def titles_stream(spark, sf_dir):
    """Events as nodes titled by their user, in three batches: the newest kept one blocks its title for five seconds."""
    e = read(spark, sf_dir, "events")
    most = e.agg(F.max("event_id")).first()[0] + 1
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), "user_id").alias("title"), (F.col("event_id") * 10).cast("long").alias("updated"), F.col("event_id").cast("long").alias("seq"), (F.col("event_id") * 10).cast("long").alias("clock"))
    return _streamed(spark, rows, F.floor(F.col("seq") * 3 / most), 3, lambda live: stateful.dedup_nodes(live, 5000, "clock"), "titles").select("id", "kept", "survivor")


_ASKED = LISTS_SQL.replace("lists AS", "asked AS", 1) + ", lists AS (SELECT * FROM asked WHERE list_id IN ('view', 'click', 'purchase') AND pos <= 40)"


@query(f"WITH {_ASKED}, {_NORM} SELECT id, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT id, sum(unit * (1.0::DOUBLE / 3)) AS score FROM norm GROUP BY id) QUALIFY rank <= 20")
def federated_answering(spark, sf_dir):
    """Three backends answer and one is down: the weighted fusion of those that are there."""
    ranked = lists(spark, sf_dir)

    def down():
        raise ConnectionError("down")

    backends = {t: (lambda t=t: ranked.filter(F.col("list_id") == t).select("query_id", "id", "score")) for t in ("view", "click", "purchase")}
    fused, _ = search.federate_answering(backends | {"error": down}, 20, "weighted", seconds=300)
    return fused.select("id", F.round("score", 8).alias("score"), F.col("rank").cast("int").alias("rank"))


def _view(spark, df, what: str) -> str:
    name = f"{what}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


@query(ORACLES["reserved_tokens"])
def reserved_in_sql(spark, sf_dir):
    """reserved_tokens() as SQL text."""
    sql.register(spark)
    asked = _view(spark, read(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderkey % 500 - 60 AS n"), "asked")
    return spark.sql(f"SELECT o_orderkey, granted, remaining FROM reserve(TABLE({asked}) PARTITION BY o_custkey ORDER BY (o_orderkey), 800, 'n')")


@query(ORACLES["accepted_messages"])
def accepted_in_sql(spark, sf_dir):
    """accepted_messages() as SQL text."""
    sql.register(spark)
    said = _view(spark, read(spark, sf_dir, "conversations"), "said")
    return spark.sql(f"SELECT conv_id, turn, role, accepted FROM accept(TABLE({said}) PARTITION BY conv_id ORDER BY (turn, role, text))")


@query(f"WITH {NODES_SQL}, {SUPPLIES_SQL} SELECT 'node' AS kind, id, tags[1] AS extra, importance AS weight FROM nodes UNION ALL SELECT 'edge', id, relation, round(weight, 6) FROM edges WHERE source = 's1' OR weight > 0.9")
def sqlite_graph(spark, sf_dir):
    """A graph copied to a SQLite file and read again, edges by a filter. The shared folder has to be mounted as a disk for that."""
    at = urlparse(_anew(spark, "sqlite"))
    if at.scheme not in ("", "file"):
        raise ValueError("SQLite needs a shared folder that is mounted as a disk")
    os.makedirs(at.path)
    path = f"{at.path}/graph.db"
    sqlite.copy_graph_to(nodes(spark, sf_dir), supplies(spark, sf_dir), path)
    n, e = sqlite.copy_graph_from(spark, path)
    some = e.filter("source = 's1' OR weight > 0.9").select(F.lit("edge").alias("kind"), "id", F.col("relation").alias("extra"), F.round("weight", 6).alias("weight"))
    return n.select(F.lit("node").alias("kind"), "id", F.get("tags", F.lit(0)).alias("extra"), F.col("importance").alias("weight")).unionByName(some)
