import math

import pytest
from pyspark.sql import functions as F

from textquarry.operators import algorithms, catalog, chat, recall, search, snapshot, traversal, vectors
from textquarry.operators import graph_store as g


def edge_table(spark, rows):
    return spark.createDataFrame([(f"e{i}", *r, "") for i, r in enumerate(rows)], "id string, source string, target string, relation string, weight double, ts string")


def node_table(spark, rows):
    base = {"type": "t", "title": "", "body": "", "tags": [], "projects": [], "agents": [], "created": "", "updated": "", "importance": 0.5, "access_count": 0, "accessed_at": "", "valid_until": "", "last_verified": ""}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in g.NODES) for r in rows], g.NODES)


def ids(df):
    return [r.id for r in df.collect()]


def test_upsert_append_delete(spark):
    old = node_table(spark, [{"id": "a", "title": "old", "created": "1", "access_count": 5}, {"id": "b", "title": "keep"}])
    new = node_table(spark, [{"id": "a", "title": "x", "created": "2"}, {"id": "a", "title": "new", "created": "3", "access_count": 7}, {"id": "c"}]).withColumn("seq", F.monotonically_increasing_id())
    got = {r.id: r for r in g.upsert_nodes(old, new.coalesce(1)).collect()}
    assert set(got) == {"a", "b", "c"} and (got["a"].title, got["a"].created, got["a"].access_count) == ("new", "1", 7)
    edges = edge_table(spark, [("a", "b", "r", 1.0)])
    more = spark.createDataFrame([("e0", "x", "y", "r", 1.0, "", 0), ("n1", "a", "b", "r", 2.0, "", 1), ("n2", "b", "c", "r", 3.0, "", 2), ("n3", "b", "c", "r", 4.0, "", 3), ("n2", "q", "c", "r", 4.0, "", 4)], "id string, source string, target string, relation string, weight double, ts string, seq int")
    assert sorted(ids(g.append_edges(edges, more))) == ["e0", "n2"]
    n, e = g.delete_nodes(old, edges, ["a"])
    assert ids(n) == ["b"] and e.count() == 0
    assert ids(g.read_nodes(old, [])) == []
    assert g.fill_defaults(spark.createDataFrame([("z", None)], "id string, importance double")).first().importance == 0.5
    s = g.stats(old, edges).first()
    assert (s.nodes, s.edges, s.avg_importance, s.by_type) == (2, 1, 0.5, {"t": 2})
    empty = g.stats(old.limit(0), edges.limit(0)).first()
    assert (empty.nodes, empty.edges, empty.avg_importance) == (0, 0, 0.0)


def test_filters_and_lifecycle(spark):
    now = "2025-03-01T00:00:00Z"
    n = node_table(spark, [
        {"id": "1", "tags": ["x"], "projects": ["p%"], "created": "2025-01-01", "updated": "2025-01-01T00:00:00Z", "importance": 0.9, "title": "T"},
        {"id": "2", "tags": ["pinned"], "created": "2025-01-02", "updated": "2025-02-28T23:00:00Z", "title": "T", "valid_until": "2025-02-01"},
        {"id": "3", "tags": ["x", "stale"], "created": "2025-01-03", "updated": "2024-01-01T00:00:00Z", "importance": 0.3},
    ])
    assert ids(g.query_nodes(n, g.NodeQuery(tag="x"))) == ["3", "1"] and ids(g.query_nodes(n, g.NodeQuery(project="p%"))) == ["1"] and ids(g.query_nodes(n, g.NodeQuery(project="pp"))) == []
    assert ids(g.query_nodes(n, g.NodeQuery(since="2025-01-02", until="2025-01-03"))) == ["2"]
    assert ids(g.query_nodes(n, g.NodeQuery(order="importance_desc", limit=1, offset=1))) == ["2"]
    d = {r.id: r.importance for r in g.decay_importance(n, 30, 0.5, 0.2, now).collect()}
    assert d == {"1": 0.45, "2": 0.5, "3": 0.2}
    assert {r.id: r.tags for r in g.tag_stale(n, 30, now).collect()}["1"] == ["x", "stale"]
    assert ids(g.expired(n, now)) == ["2"]
    touched = {r.id: (r.access_count, r.accessed_at) for r in g.touch(n, ["1"], now).collect()}
    assert touched["1"] == (1, now) and touched["2"] == (0, "")
    rows = node_table(spark, [{"id": "9", "title": "T"}, {"id": "8", "title": "fresh"}]).withColumn("seq", F.lit(1))
    after, outcome = g.upsert_dedup(n, rows, 24, now)
    assert sorted(ids(after)) == ["1", "2", "3", "8"] and sorted(map(tuple, outcome.collect())) == [("2", True), ("8", False)]
    times = ["2025-01-01T00:00:10Z", "short", "", "2025-13-01T00:00:00Z"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(g.epoch("t")).collect()] == [1735689610, 0, 0, 0]
    kv = spark.createDataFrame([("a", b"1")], "key string, value binary")
    put = spark.createDataFrame([("a", b"2", 1), ("a", b"3", 2), ("b", b"4", 1)], "key string, value binary, seq int")
    assert dict(map(tuple, g.kv_delete(g.kv_put(kv, put), ["b"]).collect())) == {"a": b"3"}


def test_search(spark):
    n = node_table(spark, [{"id": "1", "title": "Graph store", "body": "graph graph", "importance": 0.9}, {"id": "2", "title": "Other", "body": "a graph", "tags": ["graph"]}, {"id": "3", "title": "그래프 저장소", "body": "검색"}])
    assert ids(search.bm25_search(n, "GRAPH")) == ["1", "2"] and ids(search.bm25_search(n, "gr")) == [] and ids(search.bm25_search(n, "graph store")) == ["1"]
    assert ids(search.terms_search(n, "저장 검색")) == ["3"] and ids(search.terms_search(n, "store other")) == []
    assert ids(search.hybrid_search(n, "그래프", 5)) == ["3"]
    d = spark.createDataFrame([(0, "b a a"), (1, "A b"), (2, "a b"), (3, "zzz")], "pos int, text string")
    assert [(r.pos, r.score) for r in search.keyword_search(d, "a  A", 3).collect()] == [(0, 4), (1, 2), (2, 2)]


def hits(spark, lists):
    rows = [("q", n, i + 1, x, s, x) for n, items in lists.items() for i, (x, s) in enumerate(items)]
    return spark.createDataFrame(rows, "query_id string, list_id string, pos int, id string, score double, text string")


def test_fusion(spark):
    h = hits(spark, {"a": [("x", 10.0), ("y", 5.0), ("z", 0.0)], "b": [("y", 1.0), ("x", 1.0)]})
    got = {r.id: r.score for r in search.rrf(h).collect()}
    assert got["x"] == pytest.approx(1 / 61 + 1 / 62) and got["z"] == pytest.approx(1 / 63)
    assert {r.id: r.score for r in search.rrf(h, weights={"a": 2.0, "b": 0.0}).collect()}["y"] == pytest.approx(2 / 62)
    norm = search.normalize_minmax(h)
    assert sorted((r.list_id, r.id, r.score) for r in norm.collect()) == [("a", "x", 1.0), ("a", "y", 0.5), ("a", "z", 0.0), ("b", "x", 1.0), ("b", "y", 1.0)]
    assert {r.id: r.score for r in search.weighted_sum(norm, {"a": 0.7, "b": 0.3}).collect()} == pytest.approx({"x": 1.0, "y": 0.65, "z": 0.0})
    assert {r.id: r.score for r in search.comb_mnz(h, 1).collect()} == pytest.approx({"x": 11.0, "y": 6.0, "z": 0.0})
    with pytest.raises(ValueError):
        search.comb_mnz(h, 0)
    for fused in (search.rrf(h, weights={"a": 1.0}), search.weighted_sum(norm, {"a": 1.0}), search.rrf(h, weights={})):
        with pytest.raises(Exception, match="no weight for list"):
            fused.collect()
    backends = {n: h.filter(F.col("list_id") == n).select("query_id", "id", "score", "text") for n in "ab"}
    assert ids(search.federate(backends, 2).orderBy("rank")) == ["x", "y"]
    odd = spark.createDataFrame([("q", "l", 1, "a", float("nan"), ""), ("q", "l", 2, "b", float("inf"), ""), ("q", "l", 3, "c", 2.0, "")], h.schema)
    assert {r.id: r.score for r in search.normalize_minmax(odd).collect()} == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "a"), (4, None, "a"), (5, [1.0], "a")], "id long, vector array<float>, label string")
    q = spark.createDataFrame([("q", [2.0, 0.1], "a")], "query_id string, vector array<float>, label string")
    assert [r.id for r in vectors.knn(v, q, 2).orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in vectors.knn(v, q, 2, same=["label"]).orderBy("rank").collect()] == [1, 3]
    assert vectors.knn_filtered(v, q, 2, v.select("id").limit(0)).count() == 0 and vectors.knn(v, q.limit(0), 2).count() == 0
    s = spark.createDataFrame([(1, [(1, 2.0), (3, 1.0)]), (2, [(3, 5.0)])], "id long, vector array<struct<index:int,value:double>>")
    assert [(r.id, r.score) for r in vectors.sparse_search(s, s.filter("id = 1").withColumnRenamed("id", "query_id"), 5).orderBy("rank").collect()] == [(1, 5.0), (2, 5.0)]
    s = spark.createDataFrame([(1, [(1, 2.0)]), (2, [(3, 5.0)]), (3, [(1, -1.0)]), (4, []), (5, [(9, 1.0)])], s.schema)
    q1 = spark.createDataFrame([(7, [(1, 1.0)]), (8, []), (9, [(1, 1.0), (3, 1.0), (9, 1.0)])], "query_id long, vector array<struct<index:int,value:double>>")
    top = lambda k, **o: sorted((r.query_id, r["rank"], r.id, r.score) for r in vectors.sparse_search(s, q1, k, **o).collect())
    assert top(3) == [(7, 1, 1, 2.0), (7, 2, 2, 0.0), (7, 3, 4, 0.0), (9, 1, 2, 5.0), (9, 2, 1, 2.0), (9, 3, 5, 1.0)]
    assert top(9)[:5] == [(7, 1, 1, 2.0), (7, 2, 2, 0.0), (7, 3, 4, 0.0), (7, 4, 5, 0.0), (7, 5, 3, -1.0)] and len(top(9)) == 10
    assert top(1) == [(7, 1, 1, 2.0), (9, 1, 2, 5.0)] and top(2, allowed=s.filter("id > 2").select("id")) == [(7, 1, 4, 0.0), (7, 2, 5, 0.0), (9, 1, 5, 1.0), (9, 2, 4, 0.0)]
    odd = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", None), ("d", [None, 1.0])], "query_id string, vector array<float>")
    assert sorted((x.query_id, x.id) for x in vectors.knn(v, odd, 1).collect()) == [("a", 1), ("b", 5)]
    r = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "match long, vector array<float>")
    assert [(x.id, x.match) for x in vectors.fingerprint(v, r).orderBy("id").collect()] == [(1, 2), (2, 2)]
    assert sorted(x.id for x in vectors.remove_vectors(vectors.add_vectors(v, v.filter("id = 1")), v.filter("id > 2")).collect()) == [1, 2]
    assert vectors.candidates(5) == 50 and vectors.candidates(2000) == 2000 and vectors.candidates(500) == 1000
    e = vectors.embed(spark.createDataFrame([("x",), (None,)], "t string"), "t", lambda ts: [[float(len(t))] for t in ts], prefix="q: ")
    assert [x.vector for x in e.collect()] == [[4.0], [3.0]]


def test_traversal(spark):
    cycle = edge_table(spark, [("A", "B", "r", 1.0), ("B", "C", "r", 1.0), ("C", "A", "s", 1.0), ("A", "A", "r", 9.0)])
    assert sorted((r.id, r.depth) for r in traversal.related(cycle, "A", 5).collect()) == [("B", 1), ("C", 1)]
    assert sorted(ids(traversal.related(cycle, "A", 1, g.Direction.OUT, "r"))) == ["B"] and traversal.related(cycle, "A", 0).count() == 0
    assert sorted(ids(traversal.related_nodes(cycle, "A", 0))) == ["B", "C"]
    shared = edge_table(spark, [("A", "C", "r", 1.0), ("B", "C", "r", 1.0), ("C", "D", "r", 1.0)])
    seeds = spark.createDataFrame([("A",), ("B",)], "id string")
    assert [tuple(r) for r in traversal.neighbors(shared, seeds).collect()] == [("C", 2.0)]
    assert ids(g.edges_of(shared, "C", g.Direction.IN)) == ["e0", "e1"]


def test_paths(spark):
    n = spark.createDataFrame([(x, i) for i, x in enumerate("ABCDE")], "id string, pos int")
    tri = edge_table(spark, [("A", "B", "r", 0.5), ("B", "C", "r", 0.5), ("A", "C", "r", 0.1)])
    assert algorithms.shortest_path(tri, "A", "C") == ["A", "B", "C"] and algorithms.shortest_path(tri, "C", "A") is None and algorithms.shortest_path(tri, "A", "A") == ["A"]
    assert {r.id: r.dist for r in algorithms.distances(tri, "A").collect()} == pytest.approx({"A": 0.0, "B": -math.log(0.5), "C": -2 * math.log(0.5)})
    weak = edge_table(spark, [("A", "B", "r", 1e-12), ("A", "C", "r", 0.9), ("C", "B", "r", 7.0)])
    line = edge_table(spark, [(f"n{i}", f"n{i + 1}", "r", 1.0) for i in range(11)])
    assert algorithms.shortest_path(line, "n2", "n9") == [f"n{i}" for i in range(2, 10)] and algorithms.shortest_path(line, "n0", "n1") == ["n0", "n1"]
    assert algorithms.shortest_path(weak, "A", "B") == ["A", "C", "B"] and algorithms.shortest_path(tri, "Z", "A", n) is None


def test_graph_algorithms(spark):
    n = spark.createDataFrame([(x, i) for i, x in enumerate("ABCDEF")], "id string, pos int")
    e = edge_table(spark, [("A", "B", "r", 1.0), ("C", "B", "r", 1.0), ("D", "E", "r", 1.0), ("E", "Z", "r", 1.0)])
    assert {r.id: r.component for r in algorithms.components(n, e).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "F": "F"}
    ranks = {r.id: r["rank"] for r in algorithms.pagerank(n, e).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["B"] == max(ranks.values()) and ranks["A"] == pytest.approx(ranks["F"])
    ring = edge_table(spark, [(a, b, "r", 1.0) for a, b in zip("ABCDEF", "BCDEFA")])
    assert all(r["rank"] == pytest.approx(1 / 6) for r in algorithms.pagerank(n, ring).collect())
    labels = {r.id: r.label for r in algorithms.label_propagation(n, edge_table(spark, [("A", "B", "r", 1.0), ("C", "D", "r", 1.0)])).collect()}
    assert labels["A"] == labels["B"] != labels["C"] == labels["D"] and labels["F"] == "F"
    square = edge_table(spark, [("A", "C", "r", 1.0), ("B", "C", "r", 1.0), ("A", "D", "r", 1.0), ("D", "B", "r", 1.0), ("C", "C", "r", 1.0)])
    pair = algorithms.similarity(square, spark.createDataFrame([("A", "B"), ("A", "F")], "a string, b string"))
    got = {r.b: r for r in pair.collect()}
    assert (got["B"].common, got["B"].jaccard) == (2, 1.0) and got["B"].adamic_adar == pytest.approx(2 / math.log(2)) and got["F"].jaccard == 0
    assert [(r.a, r.b) for r in algorithms.link_prediction(square, 5).collect()] == [("A", "B"), ("C", "D")]


def test_links_of_hubs_in_parts(spark, monkeypatch):
    star = edge_table(spark, [("hub", f"n{i}", "r", 1.0) for i in range(30)] + [("n0", "n1", "r", 1.0)])
    want = [tuple(r) for r in algorithms.link_prediction(star, 1000).collect()]
    monkeypatch.setattr(algorithms, "HUB_ROWS", 4)
    assert [tuple(r) for r in algorithms.link_prediction(star, 1000).collect()] == want and len(want) == 30 * 29 // 2 - 1


@pytest.mark.parametrize("hub_rows, pairs", [(16_000_000, 1_000_000), (300, 40), (300, 3)])
def test_links_between_blocks_that_are_summed_in_parts(spark, monkeypatch, hub_rows, pairs):
    monkeypatch.setattr(algorithms, "HUB_ROWS", hub_rows)
    monkeypatch.setattr(algorithms, "PAIRS", pairs)
    ends = {(f"n{i * i % 47}", f"n{i * 31 % 53}") for i in range(400)} | {("n1", f"x{i}") for i in range(40)}
    near = {}
    for a, b in ends:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    score = {(a, b): sum(1 / math.log(len(near[z])) for z in near[a] & near[b]) for a in near for b in near if a < b and b not in near[a] and near[a] & near[b]}
    want = sorted(score, key=lambda p: (-round(score[p], 9), p))[:30]
    got = algorithms.link_prediction(edge_table(spark, [(a, b, "r", 1.0) for a, b in sorted(ends)]), 30).collect()
    assert [(r.a, r.b) for r in got] == want and [r.score for r in got] == pytest.approx([score[p] for p in want])


@pytest.mark.parametrize("rows, products, block", [(7, 5, 3), (500, 1_000_000, 4_096)])
def test_searches_in_slices_of_rows(spark, monkeypatch, rows, products, block):
    for name, value in (("ROWS", rows), ("PRODUCTS", products), ("QUERY_BLOCK", block)):
        monkeypatch.setattr(vectors, name, value)
    made = [(f"r{i:02}", [float(i % 5 - 2), float(i % 3), float(i % 7 - 3)], i % 4 or None) for i in range(60)]
    table = spark.createDataFrame([*made, ("none", None, 1)], "id string, vector array<double>, label int")
    asked = spark.createDataFrame([(int(i[1:]), v, g) for i, v, g in made[:8]], "query_id int, vector array<double>, label int")
    size = lambda v: math.sqrt(sum(x * x for x in v or ())) or 1.0
    dot = lambda a, b: sum(x * y for x, y in zip(a, b or ()))
    every = [*made, ("none", None, 1)]

    def best(score, same=False):
        out = []
        for q, v, g in made[:8]:
            some = [(-round(score(v, w), 12), i) for i, w, h in every if not same or g is not None and g == h]
            out += [(int(q[1:]), i, n + 1) for n, (_, i) in enumerate(sorted(some)[:6])]
        return out

    got = lambda df: sorted((r.query_id, r.id, r["rank"]) for r in df.collect())
    cos = lambda a, b: dot(a, b) / size(a) / size(b)
    assert got(vectors.knn(table, asked, 6)) == sorted(best(cos), key=lambda x: (x[0], x[1]))
    assert got(vectors.knn(table, asked, 6, same=["label"])) == sorted(best(cos, True), key=lambda x: (x[0], x[1]))
    sparse = F.transform("vector", lambda x, i: F.struct(F.concat(F.lit("term"), i).alias("index"), x.cast("float").alias("value")))
    found = vectors.sparse_search(table.withColumn("vector", sparse), asked.withColumn("vector", sparse), 6)
    assert got(found) == sorted(best(dot), key=lambda x: (x[0], x[1])) and dict(found.dtypes)["query_id"] == "int"


def test_graph_and_touch(spark):
    from textquarry.operators.graph import Graph

    n = node_table(spark, [{"id": x, "title": f"title {x}", "type": "t", "access_count": 3} for x in "ABCD"])
    graph = Graph(n, edge_table(spark, [("A", "B", "r", 0.5), ("B", "C", "r", 0.5), ("C", "Z", "r", 1.0)]))
    found, after = graph.recall(recall.RecallOptions(limit=2), "2025-01-31T00:00:00Z")
    read = sorted(ids(found))
    assert len(read) == 2 and {r.id: (r.access_count, r.accessed_at) for r in after.nodes.collect()} == {x: (4, "2025-01-31T00:00:00Z") if x in read else (3, "") for x in "ABCD"}
    assert graph.path("A", "C") == ["A", "B", "C"] and sorted(ids(graph.related("A", 3))) == ["B", "C"] and ids(graph.neighbors(n.select("id").filter("id = 'C'"))) == ["B"]
    assert graph.delete(["B"]).edges.count() == 1 and {r.component for r in graph.components().collect()} == {"A", "D"} and graph.stats().first().nodes == 4
    assert graph.ranks().count() == 4 and sorted(ids(graph.search("title", 9))) == list("ABCD") and graph.query(g.NodeQuery(type="t", limit=3)).count() == 3


def test_evaluation(spark):
    from textquarry.operators import evaluation as ev

    e = ev.estimate_errors(spark.createDataFrame([(10, 10), (13, 10), (20, 10), (1, 0)], "est int, act int"), "est", "act").first()
    assert (e.entries, e.mae, e.max_error, e.pct_within_3, e.pct_within_10pct) == (4, 3.5, 10.0, 75.0, 25.0)
    sets = spark.createDataFrame([(["a", "b"], ["a"]), ([], ["c"]), ([], [])], "f array<string>, x array<string>")
    assert tuple(ev.label_sets(sets, "f", "x").first()) == (0.5, 0.5, 0.5) and tuple(ev.label_sets(sets.limit(0), "f", "x").first()) == (1.0, 1.0, 1.0)
    assert [(r.precision, r.recall, r.f1) for r in ev.set_scores(sets, "f", "x").collect()] == [(0.5, 1.0, 2 / 3), (1.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcdefg")], "query_id string, id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "g"), ("q", "z"), ("r", "a")], "query_id string, id string")
    scores = ev.ranking_scores(ranked, relevant)
    assert {r.query_id: (r.p_at_5, round(r.r_at_5, 3), r.rr) for r in scores.collect()} == {"q": (0.2, 0.333, 0.5), "r": (0.0, 0.0, 0.0)}
    assert ev.mean_scores(scores).first().mrr == 0.25


def test_recall(spark):
    now = "2025-01-31T00:00:00Z"
    n = node_table(spark, [
        {"id": "n1", "title": "alpha beta", "updated": "2025-01-01T00:00:00Z", "projects": ["p"]}, {"id": "n2", "title": "gamma", "updated": "2025-01-01T00:00:00Z", "projects": ["p"]},
        {"id": "n3", "tags": ["stale"], "title": "alpha"}, {"id": "n4", "importance": 0.1, "updated": "2099-01-01T00:00:00Z", "access_count": 40},
    ])
    e = edge_table(spark, [("n1", "n2", "r", 1.0)])
    got = {r.id: r.score for r in recall.recall(n, e, recall.RecallOptions(), now).collect()}
    assert set(got) == {"n1", "n2", "n4"} and got["n2"] > got["n1"]  # the sink of the link ranks higher
    base = {r.id: r.score for r in recall.candidates(n, recall.RecallOptions(), now).collect()}
    assert base == pytest.approx({"n1": 0.2 * 0.5 + 0.35 * 0.5, "n2": 0.2 * 0.5 + 0.35 * 0.5, "n4": 0.2 * 0.5 + 0.035 + 0.15})
    assert ids(recall.candidates(n, recall.RecallOptions(hint="alpha"), now)) == ["n1"] and recall.candidates(n, recall.RecallOptions(hint="nowhere"), now).count() == 0
    assert ids(recall.candidates(n, recall.RecallOptions(hint="alpha", scope=g.NodeQuery(project="other")), now)) == []


def test_chat(spark):
    m = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("system", "s" * 40), ("assistant", "no"), ("user", "u" * 40), ("user", "again"), ("assistant", "a" * 40), ("tool", "t")])], "conv_id long, turn int, role string, text string")
    assert [r.valid for r in chat.transitions(m).orderBy("turn").collect()] == [True, False, True, False, True, True]
    assert [r.accepted for r in chat.accept(m).orderBy("turn").collect()] == [True, False, True, False, True, True]
    assert [r.turn for r in chat.truncate(m, 30, 5).orderBy("turn").collect()] == [0, 3, 4, 5]
    assert chat.token_counts(m).first().tokens == 10 + 1 + 10 + 1 + 10 + 1
    assert '"temperature":0.7' in chat.requests(m, "m").first().request
    lines = ['data: {"choices":[{"delta":{"content":"hi"}}]}', 'data: {"choices":[{"delta":{"content":"x","reasoning_content":"why"}}]}', 'data: {"choices":[{"delta":{}}],"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3}}', 'data: {"choices":[{"delta":{},"finish_reason":"stop"}]}', "data: [DONE]", ": ping", "data: {bad"]
    ev = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq int, l string").select("seq", chat.openai_event(chat.event_data(F.col("l"))).alias("v"))
    assert [(r.v.kind, r.v.content) if r.v else None for r in ev.orderBy("seq").collect()] == [("delta", "hi"), ("reasoning", "why"), ("usage", None), ("done", None), None, None, None]
    a = chat.assemble(ev.filter("v is not null").select(F.lit(1).alias("stream_id"), "seq", "v.*")).first()
    assert (a.content, a.reasoning, a.total_tokens, a.done) == ("hi", "why", 3, True)
    an = [("content_block_delta", '{"delta":{"type":"text_delta","text":"t"}}'), ("content_block_delta", '{"delta":{"type":"thinking_delta","thinking":"z"}}'), ("message_delta", '{"usage":{"output_tokens":5}}'), ("message_stop", "{}"), ("ping", "{}")]
    got = spark.createDataFrame(an, "e string, d string").select(chat.anthropic_event(F.col("e"), F.col("d")).alias("v")).collect()
    assert [(r.v.kind, r.v.content, r.v.completion_tokens) if r.v else None for r in got] == [("delta", "t", None), ("reasoning", "z", None), ("usage", None, 5), ("done", None, None), None]
    ok = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1}',), ("[1]",), ("x",)], "j string").select(chat.arguments_ok(F.col("j"), ["a", "b"])).collect()
    assert [r[0] for r in ok] == [True, False, False, False]
    cache = spark.createDataFrame([("k", '{"x":1}', 100), ("old", "{}", 1), ("bad", "{", 100)], "key string, response string, stored long")
    asked = spark.createDataFrame([("k",), ("old",), ("bad",), ("none",)], "key string")
    assert {r.key: r.response for r in chat.cached(asked, cache, 110, 50).collect()} == {"k": '{"x":1}', "old": None, "bad": None, "none": None}


def test_catalog(spark):
    rows = [(i, p, p, c, f, "key", k, "", "", [(m, m, "f", "", "", (cost, 2.0, None, None), (1000 * (i + 1), 1), (["text"], ["text"]), (False, m == "big", True, True, True)) for m, cost in ms]) for i, (p, c, f, k, ms) in enumerate([("openai", "cloud", "gpt", "K", [("big", 1.0), ("same", 2.0)]), ("kimi", "cloud", "k", "", [("same", 9.0)]), ("ollama", "own", "local", "", [("llama", None)])])]
    p = spark.createDataFrame(rows, catalog.PROVIDERS)
    assert [r.category for r in catalog.categories(p).collect()] == ["cloud", "own"] and catalog.key_vars(p).count() == 1
    u = spark.createDataFrame([("same", 1_000_000, 1_000_000), ("nope", 1, 1), ("llama", 1, 1)], "model string, input_tokens long, output_tokens long")
    assert {r.model: r.cost for r in catalog.estimate_cost(u, p).collect()} == {"same": 4.0, "nope": None, "llama": None}
    body = '{"openai":{"api":"a","models":{"big":{"id":"big","name":"Big","cost":{"input":5,"output":2}},"new":{"id":"new"}}},"kimi-for-coding":{"models":{}}}'
    up = catalog.payload_models(spark.createDataFrame([(body,)], "payload string"))
    merged = catalog.merge(p, up)
    assert {(r.provider, r.id): (r.state, r.price_changed) for r in merged.collect()} == {("openai", "big"): ("updated", True), ("openai", "new"): ("added", False), ("openai", "same"): ("kept", False), ("kimi", "same"): ("kept", False), ("ollama", "llama"): ("kept", False)}
    d = catalog.diff(merged).first()
    assert (d.added, d.updated, d.kept, d.price_changes, d.clean) == (1, 1, 3, 1, False)
    assert {r.id: (r.context, r.reasoning) for r in catalog.capabilities(p).collect()} == {"openai": (1000, True), "kimi": (2000, False), "ollama": (3000, False)}
    whole = {r.id: r for r in catalog.merge_catalog(p, up).collect()}
    assert [(m.id, m.name, m.cost and m.cost.input) for m in whole["openai"].models] == [("big", "Big", 5.0), ("same", "same", 2.0), ("new", None, None)] and whole["openai"].base_url == "a"
    assert [m.id for m in whole["kimi"].models] == ["same"] and [m.id for m in whole["ollama"].models] == ["llama"] and catalog.merge_catalog(p, up).columns == p.columns
    again = catalog.merge(catalog.merge_catalog(p, up), up)
    assert {(r.id, r.state) for r in again.filter("provider = 'openai'").collect()} == {("big", "same"), ("new", "same"), ("same", "kept")} and catalog.diff(again).first().clean
    same = catalog.with_discovered(p, spark.createDataFrame([("openai", 0, "big", "B1"), ("who", 1, "x", "X"), ("openai", 2, "more", "M"), ("openai", 3, "big", "B2"), ("who", 4, "y", "Y")], "provider string, pos int, id string, name string"))
    got = {r.id: [(m.id, m.name) for m in r.models] for r in same.collect()}
    assert got == {"openai": [("big", "B2"), ("same", "same"), ("more", "M")], "kimi": [("same", "same")], "ollama": [("llama", "llama")], "discovered": [("x", "X"), ("y", "Y")]}
    assert catalog.with_discovered(p, spark.createDataFrame([], "provider string, pos int, id string, name string")).count() == 3
    b = spark.createDataFrame([(0, 2, 1.0, 1.0), (1, 1, None, 1.0), (2, 1, 0.1, 0.1)], "pos int, priority int, input double, output double")
    assert [r.pos for r in catalog.route(b).collect()] == [1, 2, 0] and [r.pos for r in catalog.route(b, "lowest_cost").collect()] == [2, 0, 1]
    both = b.withColumn("at", F.lit("x")).unionByName(b.withColumn("at", F.lit(None).cast("string")))
    assert sorted((r.at or "", r.nth, r.pos) for r in catalog.trials(both, ["at"], "lowest_cost").collect()) == [(x, i + 1, p) for x in ("", "x") for i, p in enumerate((2, 0, 1))]
    with pytest.raises(ValueError):
        catalog.trials(b, [], "dearest")
    t = spark.createDataFrame([("rate_limited", 0, 500), ("server", 9, None), ("client", 1, None)], "k string, n int, after int").select(catalog.retry_bounds(F.col("k"), F.col("n"), F.col("after")).alias("b")).collect()
    assert [tuple(r.b) if r.b else None for r in t] == [(300.0, 300.0), (16.0, 48.0), None]
    assert [r[0] for r in spark.createDataFrame([(400,), (408,), (429,), (500,)], "s int").select(catalog.is_permanent(F.col("s"))).collect()] == [True, False, False, False]


def one_by_one(order, edges, rounds=10):
    at = {x: i for i, x in enumerate(order)}
    near = [[] for _ in order]
    for a, b, w in edges:
        near[at[a]].append((at[b], w))
        near[at[b]].append((at[a], w))
    label = list(range(len(order)))
    for _ in range(rounds):
        old = list(label)
        for i, ns in enumerate(near):
            votes = {}
            for j, w in ns:
                votes[label[j]] = votes.get(label[j], 0.0) + w
            if votes:
                label[i] = min(votes, key=lambda x: (-votes[x], x))
        if label == old:
            break
    return {x: order[label[i]] for i, x in enumerate(order)}


@pytest.mark.parametrize("limit", [25, 100_000])
def test_labels_of_components_larger_than_a_group(spark, monkeypatch, limit):
    import random

    monkeypatch.setattr(snapshot, "GROUP_ROWS", limit)
    rnd = random.Random(limit)
    order = [f"n{i}" for i in rnd.sample(range(120), 120)]
    edges = [(rnd.choice(order[:60]), rnd.choice(order[:60]), rnd.choice([0.25, 0.5, 1.0])) for _ in range(100)] + [("n0", x, 0.5) for x in order[60:80]]
    edges += [(order[80 + i], order[81 + i], 1.0) for i in range(6)] + [(order[90], order[91], 0.5), (order[90], order[91], 0.5), (order[95], order[95], 1.0)]
    n = spark.createDataFrame([(x, i) for i, x in enumerate(order)], "id string, pos int")
    e = spark.createDataFrame(edges + [("n0", "gone", 9.0)], "source string, target string, weight double")
    got = algorithms.label_propagation(n, e).collect()
    assert len(got) == 120 and dict(got) == one_by_one(order, edges)
    assert dict(algorithms.label_propagation(n, e, rounds=1).collect()) == one_by_one(order, edges, 1)


def test_chat_folds_gather_no_conversation(spark):
    import random

    from textquarry.functions.chunk import tokens

    rnd = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "other", None]
    rows = [(c, t, rnd.choices(roles, [1, 5, 5, 2, 1, 1])[0], rnd.choice(["", None, "word " * rnd.randrange(1, 30), "語" * 9])) for c in [1, None, 2] for t in range(400 if c == 1 else 40)]
    m = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    verdicts, kept = set(), set()
    for c in (1, None, 2):
        mine, last = [r for r in rows if r[0] == c], None
        used = sum(tokens(r[3] or "") for r in mine)
        for r in mine:
            fine = None if r[2] is None else r[2] in chat.AFTER[last]
            last = r[2] if fine else last
            verdicts.add((c, r[1], fine))
            if r[2] == "system" or used + 20 <= 300:
                kept.add(r[:2])
            else:
                used -= tokens(r[3] or "")
    accepted, truncated = chat.accept(m), chat.truncate(m, 300, 20)
    assert {(r.conv_id, r.turn, r.accepted) for r in accepted.collect()} == verdicts and accepted.count() == len(rows)
    assert sorted(map(str, ((r.conv_id, r.turn) for r in truncated.collect()))) == sorted(map(str, kept))
    for df in (accepted, truncated):
        plan = df._jdf.queryExecution().toString()
        assert "FlatMapGroupsInPandas" not in plan and "collect_list" not in plan


def test_items_that_end_with_digits_keep_them(spark):
    rows = spark.createDataFrame([("a0, b1 ,2c2,,3",), ("",)], "t string")
    assert [r.x for r in rows.select(g.split_list("t").alias("x")).collect()] == [["a0", "b1", "2c2", "3"], []]


def test_dense_components_are_voted_on_in_a_task(spark, monkeypatch):
    """160,000 edges among 401 nodes, some of them far, in no more memory than theirs; joins are for components beyond GROUP_ROWS."""
    n, rounds = 400, 10
    e = spark.range(n * n).select(F.col("id").cast("string").alias("id"), F.expr(f"cast(id div {n} as string)").alias("source"), F.expr(f"cast(id % {n} as string)").alias("target"), (F.pmod(F.xxhash64("id"), F.lit(7)) + 1).cast("double").alias("weight"))
    e = e.unionByName(spark.createDataFrame([("x", "7", "400", 2.0)], "id string, source string, target string, weight double"))
    nodes = spark.range(n + 2).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"))
    monkeypatch.setattr(snapshot.Snapshot, "_by_joins", lambda *a: pytest.fail("by joins"))
    got = {int(r.id): int(r.label) for r in algorithms.label_propagation(nodes, e, rounds).collect()}
    near, label = [[] for _ in range(n + 2)], list(range(n + 2))
    for r in e.collect():
        near[int(r.source)].append((int(r.target), r.weight))
        near[int(r.target)].append((int(r.source), r.weight))
    for _ in range(rounds):
        for i, own in enumerate(near):
            votes = {}
            for j, w in own:
                votes[label[j]] = votes.get(label[j], 0.0) + w
            label[i] = min(votes, key=lambda x: (-votes[x], x)) if votes else i
    assert got == dict(enumerate(label)) and len(set(label)) < n


def test_neighbours_are_told_apart_in_as_many_tasks_as_there_are_rows_for(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "EDGE_ROWS", 10)
    e = edge_table(spark, [(f"n{i % 20}", f"n{i % 13}", "r", 1.0) for i in range(200)])
    want = {x: {f"n{j}" for i in range(200) for k, j in ((i % 20, i % 13), (i % 13, i % 20)) if f"n{k}" == x and k != j} for x in {f"n{i}" for i in range(20)}}
    near = algorithms.undirected(e)
    assert near.rdd.getNumPartitions() >= 19
    assert sorted(map(tuple, near.collect())) == sorted((x, y) for x, ys in want.items() for y in ys)
    assert {r.id: r.degree for r in algorithms.degrees(e).collect()} == {x: len(ys) for x, ys in want.items() if ys}
