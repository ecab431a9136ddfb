"""Further registered queries: keyed reads and writes, catalogues, conversations and small text functions, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import chunk, dlp, json_text, text, vector
from textquarry.operators import algorithms, catalog, chat, evaluation, recall, search, traversal, vectors
from textquarry.operators import graph_store as g
from textquarry.operators.graph import Graph
from textquarry.plans import queries as base
from textquarry.plans.queries import CHAINS_SQL, DLP_SQL, LISTS_SQL, NODES_SQL, NOW, SUPPLIES_SQL, TOKENS_SQL, chain_nodes, chains, lists, nodes, providers, query, read, supplies
from textquarry.plans.rounds import folder
from textquarry.sources import readers
from textquarry.streaming import guard

# graph store: lookups, writes, filters


@query(f"WITH {NODES_SQL} SELECT id, title FROM nodes WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def nodes_by_ids(spark, sf_dir):
    return g.read_nodes(nodes(spark, sf_dir), read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string"))).select("id", "title")


@query(f"WITH {NODES_SQL} SELECT id, type, importance FROM nodes WHERE id IN ('3', '17', '55')")
def nodes_by_few_ids(spark, sf_dir):
    return g.read_nodes(nodes(spark, sf_dir), ["3", "17", "55", "nowhere"]).select("id", "type", "importance")


@query(f"WITH {NODES_SQL} SELECT id, updated FROM nodes ORDER BY updated DESC, id LIMIT 25")
def newest_nodes(spark, sf_dir):
    return g.latest_nodes(nodes(spark, sf_dir), 25).select("id", "updated")


@query(f"WITH {NODES_SQL}, {SUPPLIES_SQL} SELECT 'edge' AS kind, id FROM (SELECT id FROM edges ORDER BY id LIMIT 2000) UNION ALL SELECT 'node', id FROM nodes")
def graph_snapshot(spark, sf_dir):
    n, e = g.snapshot(nodes(spark, sf_dir), supplies(spark, sf_dir))
    return e.select(F.lit("edge").alias("kind"), "id").unionByName(n.select(F.lit("node").alias("kind"), "id"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplies in two relations: lines that were returned and those that were not."""
    kind = F.when(F.col("l_returnflag") == "R", "returned").otherwise("sold")
    line = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", kind.alias("relation")).agg((F.avg("l_quantity") / 50).alias("weight"))
    s, p = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    return line.select(F.concat_ws("-", s, p, "relation").alias("id"), s.alias("source"), p.alias("target"), "relation", "weight", F.lit("").alias("ts"))


TRADES_SQL = """trades AS (SELECT 's' || l_suppkey || '-p' || l_partkey || '-' || relation AS id, 's' || l_suppkey AS source, 'p' || l_partkey AS target, relation, weight
  FROM (SELECT l_suppkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'sold' END AS relation, avg(l_quantity) / 50 AS weight FROM lineitem GROUP BY ALL))"""


@query(f"WITH {TRADES_SQL} SELECT id, round(weight, 6) AS weight FROM trades WHERE (source = 'p5' OR target = 'p5') AND relation = 'returned'")
def edges_of_relation(spark, sf_dir):
    return g.edges_of(trades(spark, sf_dir), "p5", g.Direction.BOTH, "returned").select("id", F.round("weight", 6).alias("weight"))


@query(f"WITH {TRADES_SQL} SELECT id FROM trades WHERE target = 'p7'")
def edges_in(spark, sf_dir):
    return g.edges_of(trades(spark, sf_dir), "p7", g.Direction.IN).select("id")


@query(f"WITH {SUPPLIES_SQL} SELECT id FROM edges WHERE source NOT IN ('s1', 's2') AND target <> 'p5' UNION ALL SELECT DISTINCT source FROM edges WHERE source NOT IN ('s1', 's2') UNION ALL SELECT DISTINCT target FROM edges WHERE target <> 'p5'")
def deleted_nodes(spark, sf_dir):
    n, e = g.delete_nodes(base.supply_nodes(spark, sf_dir), supplies(spark, sf_dir), ["s1", "s2", "p5"])
    return e.select("id").unionByName(n.select("id"))


@query(f"WITH {TRADES_SQL} SELECT count(*) AS edges FROM trades WHERE id NOT IN ('s1-p1-sold', 's2-p5-returned', 's3-p9-sold')")
def deleted_edges(spark, sf_dir):
    return g.delete_edges(trades(spark, sf_dir), ["s1-p1-sold", "s2-p5-returned", "s3-p9-sold"]).agg(F.count("*").alias("edges"))


@query("SELECT r_name AS key, coalesce((SELECT max_by(n_name, n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND n_regionkey < 3), CAST(r_regionkey AS VARCHAR)) AS value FROM region WHERE r_name IN ('AFRICA', 'EUROPE')")
def kept_values(spark, sf_dir):
    """Regions' numbers, overwritten by their nations one after the other; one key is deleted, two are read."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    store = r.select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    puts = n.filter("n_regionkey < 3").join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("key"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("seq"))
    return g.kv_get(g.kv_delete(g.kv_put(store, puts), ["ASIA"]), ["AFRICA", "EUROPE", "ASIA"])


@query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(lang, '') AS title, 0.5::DOUBLE AS importance, 0::BIGINT AS access_count, 0 AS tags, '' AS valid_until FROM documents")
def defaulted_nodes(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"))
    return g.fill_defaults(old).select("id", "title", "importance", "access_count", F.size("tags").alias("tags"), "valid_until")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 0")
def updated_index(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    added = vectors.add_vectors(e, e.filter("vec_id % 3 = 0").withColumn("label", F.lit(99)), id_="vec_id")
    return vectors.remove_vectors(added, e.filter("vec_id % 5 = 0").select("vec_id"), id_="vec_id")


@query(f"WITH {NODES_SQL} SELECT id, updated FROM nodes WHERE (list_contains(tags, 'stale') OR list_contains(tags, 'pinned')) AND type IN ('src1', 'src2') ORDER BY updated DESC, id LIMIT 100")
def tagged_nodes(spark, sf_dir):
    return g.query_nodes(nodes(spark, sf_dir), g.NodeQuery(any_tags=["stale", "pinned"], types=["src1", "src2"], order="updated_desc", limit=100)).select("id", "updated")


@query(f"WITH {NODES_SQL} SELECT id FROM nodes WHERE list_contains(tags, 'en') AND list_contains(projects, 'src2') AND type = 'src2'")
def nodes_of_any_case(spark, sf_dir):
    return nodes(spark, sf_dir).filter(g.in_scope(g.NodeQuery(tag="EN", project="SRC2", type="src2"), any_case=True)).select("id")


@query(f"WITH {NODES_SQL} SELECT id, created FROM nodes ORDER BY created, id LIMIT 200 OFFSET 10")
def oldest_nodes(spark, sf_dir):
    """The limit asked for is above the greatest that a query gives."""
    return g.query_nodes(nodes(spark, sf_dir), g.NodeQuery(order="created_asc", limit=1_000, offset=10)).select("id", "created")


@query(f"WITH {NODES_SQL} SELECT id, valid_until FROM nodes WHERE valid_until <> '' AND valid_until < '{NOW}'")
def expired_nodes(spark, sf_dir):
    return g.expired(nodes(spark, sf_dir), NOW).select("id", "valid_until")


@query(f"WITH {NODES_SQL}, new AS (SELECT 'n' || id AS id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN title ELSE id || title END AS title FROM nodes WHERE CAST(id AS BIGINT) % 3 = 0), old AS (SELECT title, max_by(id, updated || id) AS old FROM nodes WHERE updated > '2024-01-15T00:00:00Z' GROUP BY title) SELECT coalesce(old, id) AS id, old IS NOT NULL AS was_duplicate, (SELECT count(*) FROM nodes) + (SELECT count(*) FROM new LEFT JOIN old USING (title) WHERE old IS NULL) AS nodes FROM new LEFT JOIN old USING (title)")
def deduplicated_upserts(spark, sf_dir):
    """Every third document comes again under a new id, half of them with their old title."""
    n = nodes(spark, sf_dir)
    number = F.col("id").cast("long")
    rows = n.filter(number % 3 == 0).withColumns({"title": F.when(number % 2 == 0, F.col("title")).otherwise(F.concat("id", "title")), "id": F.concat(F.lit("n"), F.col("id")), "seq": number})
    after, outcome = g.upsert_dedup(n, rows, 46 * 24, NOW)
    return outcome.join(F.broadcast(after.agg(F.count("*").alias("nodes"))))  # one row


@query(f"WITH {NODES_SQL} SELECT id, access_count + CASE WHEN id IN ('1', '2', '3') THEN 1 ELSE 0 END AS access_count, CASE WHEN id IN ('1', '2', '3') THEN '{NOW}' ELSE '' END AS accessed_at, CASE WHEN id = '2' THEN '{NOW}' ELSE '' END AS last_verified FROM nodes")
def touched_nodes(spark, sf_dir):
    return g.mark_verified(g.touch(nodes(spark, sf_dir), ["1", "2", "3"], NOW), "2", NOW).select("id", "access_count", "accessed_at", "last_verified")


@query(f"WITH {NODES_SQL} SELECT id, importance FROM (SELECT *, lower(title || ' ' || body || ' ' || array_to_string(tags, ',')) AS t FROM nodes) WHERE contains(t, 'token') AND contains(t, 'en') ORDER BY importance DESC, updated DESC, id LIMIT 50")
def joined_terms_top(spark, sf_dir):
    return search.terms_search(nodes(spark, sf_dir), "token EN", 50, joined=True).select("id", "importance")


@query(base._bm25_sql("password") + f""", b AS (SELECT id FROM (SELECT * FROM nodes WHERE contains(lower(title), 'password') OR contains(lower(body), 'password') OR contains(lower(array_to_string(tags, ',')), 'password') ORDER BY importance DESC, id LIMIT 80) WHERE id NOT IN (SELECT id FROM hits)),
  m AS (SELECT id FROM (SELECT id, 0 AS s, bm25, importance FROM hits UNION ALL SELECT id, 1, 0.0, importance FROM b JOIN nodes USING (id)) ORDER BY s, bm25, importance DESC, id LIMIT 80),
  w AS (SELECT * FROM nodes WHERE NOT list_contains(tags, 'stale') ORDER BY importance DESC, updated DESC, id LIMIT 80)
  SELECT id, round({base._RECALL} + CASE WHEN id IN (SELECT id FROM m) THEN 0.2::DOUBLE ELSE 0 END, 6) AS score FROM w ORDER BY {base._RECALL} + CASE WHEN id IN (SELECT id FROM m) THEN 0.2::DOUBLE ELSE 0 END DESC, id LIMIT 20""")
def recall_ungated(spark, sf_dir):
    o = recall.RecallOptions(hint="password", limit=20, gate_by_hint=False)
    return recall.candidates(nodes(spark, sf_dir), o, NOW).select("id", F.round("score", 6).alias("score"))


_SESSION = f"""WITH {NODES_SQL}, kept AS (SELECT * FROM nodes WHERE id NOT IN ('0', '39')),
  best AS (SELECT id FROM (SELECT * FROM kept WHERE NOT list_contains(tags, 'stale') ORDER BY importance DESC, updated DESC, id LIMIT 200) ORDER BY {base._RECALL} DESC, id LIMIT 50)"""


@query(f"{_SESSION} SELECT id, access_count + (id IN (SELECT id FROM best))::INT AS access_count, CASE WHEN id IN (SELECT id FROM best) THEN '{NOW}' ELSE '' END AS accessed_at FROM kept")
def recalled_and_touched(spark, sf_dir):
    """A session with a graph as one value: two nodes go, a recall reads, and what it found counts as read in the graph after it."""
    whole = Graph(nodes(spark, sf_dir), supplies(spark, sf_dir)).delete(["0", "39"])
    _, after = whole.recall(recall.RecallOptions(limit=50), NOW)
    return after.nodes.select("id", "access_count", "accessed_at")


# traversal and algorithms


@query(f"WITH {TRADES_SQL}, r AS (SELECT source, target FROM trades WHERE relation = 'returned'), a AS (SELECT DISTINCT source AS id FROM r WHERE target = 'p5') SELECT id, 1 AS depth FROM a UNION ALL SELECT DISTINCT target, 2 FROM r WHERE source IN (SELECT id FROM a) AND target <> 'p5'")
def related_by_relation(spark, sf_dir):
    return traversal.related(trades(spark, sf_dir), "p5", 2, g.Direction.BOTH, "returned").select("id", F.col("depth").cast("int").alias("depth"))


@query(f"WITH {TRADES_SQL} SELECT target AS id, round(sum(weight), 6) AS weight FROM trades WHERE source IN ('s1', 's4') AND relation = 'sold' GROUP BY target")
def neighbors_out(spark, sf_dir):
    seeds = spark.createDataFrame([("s1",), ("s4",)], "id string")
    return traversal.neighbors(trades(spark, sf_dir), seeds, g.Direction.OUT, "sold").select("id", F.round("weight", 6).alias("weight"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS nth FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 1)")
def path_of_orders(spark, sf_dir):
    """From the first to the last order of the customer who has the least one."""
    o = read(spark, sf_dir, "orders")
    first = o.orderBy("o_orderkey").first()
    last = o.filter(F.col("o_custkey") == first.o_custkey).agg(F.max("o_orderkey")).first()[0]
    way = algorithms.shortest_path(chains(spark, sf_dir), str(first.o_orderkey), str(last))
    return spark.createDataFrame([(x, i) for i, x in enumerate(way or [])], "id string, nth int")


def hand_overs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of consecutive lines of an order, weighted by how often they follow each other: a graph with cycles."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("next"))
    pairs = line.join(after, ["l_orderkey", "l_linenumber"]).groupBy(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("s"), "next").alias("target")).agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(F.concat_ws("-", "source", "target").alias("id"), "source", "target", F.lit("then").alias("relation"), "weight", F.lit("").alias("ts"))


_HAND_OVERS = "edges AS (SELECT 's' || a.l_suppkey AS source, 's' || b.l_suppkey AS target, count(*)::DOUBLE AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL), ids AS (SELECT 's' || s_suppkey AS id FROM supplier)"


@query(base.converged_sql(_HAND_OVERS, 30) + " SELECT id, round(r / sum(r) OVER (), 8) AS rank FROM every JOIN chosen USING (k)")
def supplier_ranks(spark, sf_dir):
    """PageRank with its defaults, to convergence."""
    ids = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return algorithms.pagerank(ids, hand_overs(spark, sf_dir)).select("id", F.round("rank", 8).alias("rank"))


@query(f"WITH {_HAND_OVERS}, n AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM edges WHERE source <> target UNION ALL SELECT target, source FROM edges WHERE source <> target)), deg AS (SELECT a AS z, count(*) AS d FROM n GROUP BY a), c AS (SELECT x.b AS a, y.b AS b, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS s FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN deg ON deg.z = x.a GROUP BY ALL) SELECT a, b, round(s, 6) AS score FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.a = c.a AND n.b = c.b) ORDER BY round(s, 9) DESC, a, b LIMIT 50")
def predicted_hand_overs(spark, sf_dir):
    return algorithms.link_prediction(hand_overs(spark, sf_dir), 50).select("a", "b", F.round("score", 6).alias("score"))


# texts


@query("SELECT doc_id, '語 ' || doc_id || '한 국 ' || coalesce(lang, '') || 'ア ' AS segmented FROM documents")
def segmented_cjk(spark, sf_dir):
    t = F.concat(F.lit("語"), F.col("doc_id").cast("string"), F.lit("한국"), F.coalesce("lang", F.lit("")), F.lit("ア"))
    return read(spark, sf_dir, "documents").select("doc_id", text.segment_cjk(t).alias("segmented"))


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS batch FROM orders")
def order_batches(spark, sf_dir):
    return chunk.chunk_batch(read(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey")


@query("""WITH RECURSIVE q AS (SELECT o_custkey, o_orderkey, o_orderkey % 500 - 60 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT o_custkey, 0::BIGINT AS i, 0::BIGINT AS used, false AS granted, 0::BIGINT AS o_orderkey FROM (SELECT DISTINCT o_custkey FROM orders)
  UNION ALL SELECT q.o_custkey, q.i, CASE WHEN n <= 0 OR used + n <= 800 THEN greatest(0, used + n) ELSE used END, n <= 0 OR used + n <= 800, q.o_orderkey FROM f JOIN q ON q.o_custkey = f.o_custkey AND q.i = f.i + 1)
SELECT o_orderkey, granted, 800 - used AS remaining FROM f WHERE i > 0""")
def reserved_tokens(spark, sf_dir):
    """A customer's orders ask for tokens of one budget; some give back."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 500 - 60).alias("n"))
    return chunk.reserve(o, 800, "o_custkey", "o_orderkey", "n").select("o_orderkey", "granted", "remaining")


_DIGITS = "lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || CAST(1 + o_orderkey % 4 AS VARCHAR) || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') || CAST(o_orderkey % 3 AS VARCHAR)"
_SUM = "list_sum(list_transform(range(1, 13), lambda i: CAST(substr(d, i, 1) AS INTEGER) * [2,3,4,5,6,7,8,9,2,3,4,5][i]))"


@query(f"SELECT o_orderkey, (11 - {_SUM} % 11) % 10 = CAST(substr(d, 13, 1) AS INTEGER) AS valid FROM (SELECT o_orderkey, {_DIGITS} AS d FROM orders)")
def resident_numbers(spark, sf_dir):
    """Numbers with a check digit made of orders, a tenth of them right; flags, sensitivity and spans agree."""
    k = F.col("o_orderkey")
    d = F.concat(F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("-"), (1 + k % 4).cast("string"), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0"), (k % 3).cast("string"))
    t = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("no. "), d, F.lit(".")).alias("t"))
    hit = F.array_contains(dlp.rule_hits("t"), "rrn_kr")
    return t.select("o_orderkey", (hit & (dlp.sensitivity(dlp.rule_hits("t")) == "restricted") & F.exists(dlp.scan("t"), lambda f: (f["rule"] == "rrn_kr") & (f["start"] == 4) & (f["end"] == 18))).alias("valid"))


@query("SELECT event_id, event_type <> 'error' AND user_id % 3 <> 0 AS ok FROM events")
def env_keys(spark, sf_dir):
    name = F.concat(F.when(F.col("user_id") % 3 == 0, "9").otherwise("_"), F.upper("event_type"), F.when(F.col("event_type") == "error", "-X").otherwise("_X1"))
    return read(spark, sf_dir, "events").select("event_id", text.is_env_key(name).alias("ok"))


@query("SELECT doc_id, md5('x' || coalesce(text, '') || 'y') AS decoded FROM documents")
def shell_round_trip(spark, sf_dir):
    t = F.concat(F.lit("x"), F.coalesce("text", F.lit("")), F.lit("y"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(json_text.shell_decode(json_text.shell_encode(t))).alias("decoded"))


@query("SELECT event_id, 'Q: a' || chr(10) || 'A: ' || event_type || chr(10) || 'Now ' || user_id || '.' AS prompt FROM events")
def few_shot_prompts(spark, sf_dir):
    shots = F.array(F.lit("Q: a"), F.concat(F.lit("A: "), F.col("event_type")))
    return read(spark, sf_dir, "events").select("event_id", text.render_template(shots, F.lit("Now {{n}}."), {"n": F.col("user_id").cast("string")}).alias("prompt"))


@query("SELECT page_id, 'see ' || regexp_replace(url, '^(\\w+://)', '\\1****@') || ' and ftp://****@h/x' AS t FROM pages")
def redacted_urls(spark, sf_dir):
    t = F.concat(F.lit("see "), F.regexp_replace("url", r"^(\w+://)", "$1us:p%40w@"), F.lit(" and ftp://a@h/x"))
    return read(spark, sf_dir, "pages").select("page_id", text.redact_url_credentials(t).alias("t"))


@query(f"WITH t AS {TOKENS_SQL} SELECT count(*) AS entries, round(avg(abs(tokens - n_chars / 4)), 4) AS mae, max(abs(tokens - n_chars / 4))::DOUBLE AS max_error, round(sum(CASE WHEN abs(tokens - n_chars / 4) <= 3 THEN 1 ELSE 0 END) / count(*) * 100.0::DOUBLE, 4) AS pct_within_3, round(sum(CASE WHEN n_chars > 0 AND abs(tokens - n_chars / 4) <= 0.1::DOUBLE * n_chars / 4 THEN 1 ELSE 0 END) / count(*) * 100.0::DOUBLE, 4) AS pct_within_10pct FROM t JOIN documents USING (doc_id)")
def estimate_quality(spark, sf_dir):
    """The token estimate against a quarter of the characters."""
    d = read(spark, sf_dir, "documents").select(text.estimate_tokens("text").alias("est"), (F.col("n_chars") / 4).alias("act"))
    e = evaluation.estimate_errors(d, "est", "act")
    return e.select("entries", F.round("mae", 4).alias("mae"), "max_error", F.round("pct_within_3", 4).alias("pct_within_3"), F.round("pct_within_10pct", 4).alias("pct_within_10pct"))


@query(f"SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM (SELECT sum(CASE WHEN s AND hit THEN 1 ELSE 0 END) / sum(CASE WHEN hit THEN 1 ELSE 0 END) AS p, sum(CASE WHEN s AND hit THEN 1 ELSE 0 END) / sum(CASE WHEN s THEN 1 ELSE 0 END) AS r FROM (SELECT contains(lower(coalesce(text, '')), 'password') OR contains(lower(coalesce(text, '')), 'token') AS s, rules <> '' AS hit FROM {DLP_SQL} JOIN documents USING (doc_id)))")
def label_quality(spark, sf_dir):
    """Whether a text names a password or token, as the label that the DLP rules should find."""
    low = F.lower(F.coalesce("text", F.lit("")))
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    d = read(spark, sf_dir, "documents").select(some(F.size(dlp.rule_hits("text")) > 0).alias("f"), some(F.contains(low, F.lit("password")) | F.contains(low, F.lit("token"))).alias("x"))
    return evaluation.label_sets(d, "f", "x").select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {LISTS_SQL}, rel AS (SELECT list_id, id FROM lists WHERE id % 7 = 0), h AS (SELECT list_id, sum(CASE WHEN pos <= 5 THEN 1 ELSE 0 END) AS k, min(pos) AS first FROM lists JOIN rel USING (list_id, id) GROUP BY list_id), n AS (SELECT list_id, count(*) AS n FROM rel GROUP BY list_id) SELECT round(avg(coalesce(k, 0) / 5), 6) AS p_at_5, round(avg(coalesce(k, 0) / n), 6) AS r_at_5, round(avg(coalesce(1.0::DOUBLE / first, 0.0)), 6) AS mrr FROM n LEFT JOIN h USING (list_id)")
def ranking_quality(spark, sf_dir):
    """Each event type's list of users, where those whose id 7 divides are relevant."""
    ranked = lists(spark, sf_dir).select(F.col("list_id").alias("query_id"), "id", F.col("pos").alias("rank"))
    m = evaluation.mean_scores(evaluation.ranking_scores(ranked, ranked.filter("id % 7 = 0")))
    return m.select(*(F.round(c, 6).alias(c) for c in ("p_at_5", "r_at_5", "mrr")))


@query("WITH s AS (SELECT vec_id, i, v FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings) WHERE v <> 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) <= 2), q AS (SELECT DISTINCT vec_id AS query_id FROM s WHERE vec_id % 50 = 0), p AS (SELECT query_id, id, coalesce(score, 0.0) AS score FROM q CROSS JOIN (SELECT vec_id AS id FROM embeddings WHERE label < 6) LEFT JOIN (SELECT a.vec_id AS query_id, b.vec_id AS id, sum(a.v::DOUBLE * b.v::DOUBLE) AS score FROM s a JOIN s b USING (i) GROUP BY ALL) USING (query_id, id)) SELECT query_id, id, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 40")
def sparse_filtered_top(spark, sf_dir):
    """Two entries a vector: most share none with a query, so rows with score 0 fill the lists."""
    e = read(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), vector.prune_top_k(vector.sparse(F.sequence(F.lit(1), F.size("embedding")), "embedding"), 2).alias("vector"))
    found = vectors.sparse_search(rows, rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 40, allowed=e.filter("label < 6").select("vec_id"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


# catalogues


@query("SELECT r_name AS id FROM region WHERE r_regionkey >= 2")
def providers_of_category(spark, sf_dir):
    return catalog.by_category(providers(spark, sf_dir), "b").select("id")


@query("SELECT CASE WHEN r_regionkey < 2 THEN 'a' ELSE 'b' END AS category, CAST(min(r_regionkey) AS INTEGER) AS pos FROM region GROUP BY 1")
def provider_categories(spark, sf_dir):
    return catalog.categories(providers(spark, sf_dir))


@query("SELECT r_name || '_KEY' AS key_var FROM region")
def provider_keys(spark, sf_dir):
    return catalog.key_vars(providers(spark, sf_dir))


@query("SELECT n_name AS id, r_name AS provider, lower(n_name) AS name, n_nationkey * 1000::BIGINT AS context FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 = 1")
def found_models(spark, sf_dir):
    ids = read(spark, sf_dir, "nation").filter("n_nationkey % 4 = 1").select(F.col("n_name").alias("id")).unionByName(spark.createDataFrame([("none",)], "id string"))
    return catalog.find_model(providers(spark, sf_dir), ids).select("id", "provider", "name", F.col("limit.context").alias("context"))


_ASKED = ["openai", "gemini", "zai-cn", "kimi"]
_pick = lambda names, c: "CASE " + " ".join(f"WHEN {c} = {i} THEN '{n}'" for i, n in enumerate(names) if n) + " END"


@query(f"SELECT user_id, id, kind, upstream, count(*) AS calls FROM (SELECT user_id, coalesce({_pick(_ASKED, 'event_id % 5')}, event_type) AS id FROM events) JOIN (VALUES ('openai', 'exact', 'openai'), ('gemini', 'aliased', 'google'), ('zai-cn', 'aliased', 'zai'), ('kimi', 'aliased', 'kimi-for-coding'), (NULL, 'manual', NULL)) t(known, kind, upstream) ON coalesce(known, '') = CASE WHEN id IN ('openai', 'gemini', 'zai-cn', 'kimi') THEN id ELSE '' END GROUP BY ALL")
def resolved_providers(spark, sf_dir):
    """Calls of each user by the upstream that their provider's name leads to; event types are providers that nobody knows."""
    calls = read(spark, sf_dir, "events").select("user_id", F.coalesce(F.expr(_pick(_ASKED, "event_id % 5")), F.col("event_type")).alias("id"))
    return calls.select("user_id", "id", catalog.resolve(F.col("id")).alias("m")).groupBy("user_id", "id", "m.kind", "m.upstream").agg(F.count("*").alias("calls"))


_NAMES = ["openai", "gemini", "kimi", "elsewhere", "deepseek"]
_UPSTREAM = ["openai", "google", "kimi-for-coding", None, "deepseek"]


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """providers() under names that upstream knows, all but one."""
    return providers(spark, sf_dir).withColumn("id", F.expr(_pick(_NAMES, "pos")))


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upstream's answer: every even nation is a model, dearer for those that 4 divides; each provider has a new one."""
    n = read(spark, sf_dir, "nation").withColumn("up", F.expr(_pick(_UPSTREAM, "n_regionkey"))).filter("up is not null")
    k = F.col("n_nationkey")
    model = F.struct(F.col("n_name").alias("id"), F.struct((k + F.when(k % 4 == 0, 7).otherwise(1)).cast("double").alias("input"), (k * 2.0).alias("output")).alias("cost"))
    of = n.filter("n_nationkey % 2 = 0").groupBy("up").agg(F.map_from_entries(F.collect_list(F.struct("n_name", model))).alias("models"))
    new = F.create_map(F.lit("fresh"), F.struct(F.lit("fresh").alias("id"), F.struct(F.lit(1.0).alias("input"), F.lit(1.0).alias("output")).alias("cost")))
    top = of.select("up", F.struct(F.concat(F.lit("https://"), "up").alias("api"), F.map_concat("models", new).alias("models")).alias("p"))
    return top.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("up", "p")))).alias("payload"))


_MERGED = f"""m AS (SELECT {_pick(_NAMES, 'n_regionkey')} AS provider, n_name AS id, CASE WHEN n_regionkey = 3 OR n_nationkey % 2 = 1 THEN 'kept' ELSE 'updated' END AS state,
  n_regionkey <> 3 AND n_nationkey % 4 = 0 AS price_changed FROM nation UNION ALL SELECT {_pick(_NAMES, 'r_regionkey')}, 'fresh', 'added', false FROM region WHERE r_regionkey <> 3)"""


@query(f"WITH {_MERGED} SELECT * FROM m")
def catalog_changes(spark, sf_dir):
    up = catalog.payload_models(_payload(spark, sf_dir))
    return catalog.merge(_known(spark, sf_dir), up).select("provider", "id", "state", "price_changed")


@query(f"WITH {_MERGED} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'updated') AS updated, count(*) FILTER (state = 'kept') AS kept, count(*) FILTER (price_changed) AS price_changes, false AS clean FROM m")
def catalog_diff(spark, sf_dir):
    up = catalog.payload_models(_payload(spark, sf_dir))
    return catalog.diff(catalog.merge(_known(spark, sf_dir), up))


@query(f"SELECT {_pick(_NAMES, 'r_regionkey')} AS id, CASE WHEN r_regionkey = 3 THEN '' ELSE 'https://' || {_pick(_UPSTREAM, 'r_regionkey')} END AS base_url, string_agg(n || ':' || c, ',' ORDER BY n = 'fresh', n) AS models FROM (SELECT r_regionkey, n_name AS n, CAST(CASE WHEN n_regionkey = 3 OR n_nationkey % 4 <> 0 THEN n_nationkey + 1 ELSE n_nationkey + 7 END AS INTEGER) AS c FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, 'fresh', 1 FROM region WHERE r_regionkey <> 3) GROUP BY r_regionkey")
def merged_catalog(spark, sf_dir):
    merged = catalog.merge_catalog(_known(spark, sf_dir), catalog.payload_models(_payload(spark, sf_dir)))
    return merged.select("id", "base_url", F.array_join(F.transform("models", lambda m: F.concat_ws(":", m["id"], m["cost"]["input"].cast("int").cast("string"))), ",").alias("models"))


@query("SELECT r_name AS provider, n_name AS id, n_nationkey % 5 = 4 AND n_regionkey <> 0 AS replaced FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'discovered', n_name, true FROM nation WHERE n_nationkey % 5 = 1")
def discovered_models(spark, sf_dir):
    """Some models come again from their own provider, others from providers that the catalogue lacks."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    mine = n.join(r, n.n_regionkey == r.r_regionkey).filter("n_nationkey % 5 = 4 and n_regionkey <> 0").select(F.col("r_name").alias("provider"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id"), F.lit("again").alias("name"))
    other = n.filter("n_nationkey % 5 = 1").select(F.concat(F.lit("host"), "n_nationkey").alias("provider"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id"), F.lit("again").alias("name"))
    found = catalog.with_discovered(providers(spark, sf_dir), mine.unionByName(other))
    return catalog.models(found).select("provider", "id", (F.col("name") == "again").alias("replaced"))


_COSTS = "CASE WHEN ps % 6 = 5 THEN 'infinity'::DOUBLE ELSE (ps % 7 + ps % 3) / 2 END"
_BACKENDS = "FROM (SELECT s_nationkey AS nation, s_suppkey AS ps FROM supplier)"


def _backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are the backends of their nation; some have no price."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), k.alias("pos"), (k % 5).alias("priority"), F.when(k % 6 != 5, (k % 7).cast("double")).alias("input"), (k % 3).cast("double").alias("output"))


@query(f"SELECT nation, ps AS backend, CAST(row_number() OVER (PARTITION BY nation ORDER BY {_COSTS}, ps) AS INTEGER) AS nth {_BACKENDS}")
def routed_backends(spark, sf_dir):
    return catalog.trials(_backends(spark, sf_dir), ["nation"], "lowest_cost").select("nation", F.col("pos").alias("backend"), "nth")


@query(f"SELECT nation, ps AS backend, CAST(row_number() OVER (PARTITION BY nation ORDER BY ps % 5, ps) AS INTEGER) AS nth {_BACKENDS}")
def fallback_backends(spark, sf_dir):
    return catalog.trials(_backends(spark, sf_dir), ["nation"]).select("nation", F.col("pos").alias("backend"), "nth")


@query("SELECT event_id, s BETWEEN 400 AND 499 AND s NOT IN (408, 429) AS permanent, CASE WHEN s >= 500 OR s = 429 THEN greatest(CASE WHEN s = 429 THEN least(user_id, 300) ELSE 0 END, least(0.5::DOUBLE * pow(2, least(event_id % 9, 6)), 60) * 0.5::DOUBLE) END AS low FROM (SELECT event_id, user_id, 400 + event_id % 150 AS s FROM events)")
def retry_rules(spark, sf_dir):
    s = 400 + F.col("event_id") % 150
    kind = F.when(s == 429, "rate_limited").when(s >= 500, "server").otherwise("client")
    bounds = catalog.retry_bounds(kind, F.col("event_id") % 9, F.col("user_id"))
    return read(spark, sf_dir, "events").select("event_id", catalog.is_permanent(s).alias("permanent"), bounds["low"].alias("low"))


# conversations and events


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS joined FROM conversations WHERE role <> 'assistant' AND text IS NOT NULL GROUP BY conv_id")
def message_texts(spark, sf_dir):
    """A conversation as one message of parts, of which the assistant's are images."""
    c = read(spark, sf_dir, "conversations").filter("text is not null")
    parts = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "assistant", "image").otherwise("text").alias("type"), "text"))).alias("parts"))
    return parts.filter(F.exists("parts", lambda p: p["type"] == "text")).select("conv_id", chat.message_text(F.col("parts")).alias("joined"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 100 <= 50 AND event_id % 6 <> 0 THEN props END AS response FROM events")
def cached_answers(spark, sf_dir):
    """Answers of every second event are stored, some too long ago and some broken."""
    e = read(spark, sf_dir, "events")
    key = lambda c: chat.cache_key(F.lit("m"), F.col(c).cast("string"))
    store = e.filter("event_id % 2 = 0").select(key("event_id").alias("key"), F.when(F.col("event_id") % 6 == 0, "{").otherwise(F.col("props")).alias("response"), (1000 - F.col("event_id") % 100).alias("stored"))
    return chat.cached(e.select("event_id", key("event_id").alias("key")), store, 1000, 50).select("event_id", "response")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'delta' WHEN 'click' THEN 'reasoning' WHEN 'purchase' THEN 'usage' ELSE 'done' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN props END AS content, CASE WHEN event_type = 'purchase' THEN CAST(user_id AS INTEGER) END AS completion_tokens, CASE WHEN event_type = 'view' THEN props ELSE 'thought' END AS promoted FROM events WHERE event_type <> 'error'")
def decoded_blocks(spark, sf_dir):
    """The second kind of event stream, and reasoning in place of empty content."""
    e, kind = read(spark, sf_dir, "events"), F.col("event_type")
    name = F.when(kind.isin("view", "click"), "content_block_delta").when(kind == "purchase", "message_delta").when(kind == "error", "ping").otherwise("message_stop")
    said = F.to_json(F.struct(F.struct(F.lit("text_delta").alias("type"), F.col("props").alias("text")).alias("delta")))
    thought = F.to_json(F.struct(F.struct(F.lit("thinking_delta").alias("type"), F.col("props").alias("thinking")).alias("delta")))
    used = F.to_json(F.struct(F.struct(F.col("user_id").alias("output_tokens")).alias("usage")))
    data = F.when(kind == "view", said).when(kind == "click", thought).when(kind == "purchase", used).otherwise("{}")
    v = e.select("event_id", kind, "props", chat.anthropic_event(name, data).alias("v")).filter("v is not null")
    return v.select("event_id", "v.kind", "v.content", "v.completion_tokens", chat.promote(F.when(F.col("event_type") == "view", F.col("props")).otherwise(""), F.lit("thought")).alias("promoted"))


@query("SELECT user_id AS stream_id, coalesce(string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'view'), '') AS content, coalesce(string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'click'), '') AS reasoning, max(event_id) FILTER (event_type = 'purchase') AS total_tokens, bool_or(event_type NOT IN ('view', 'click', 'purchase')) AS done FROM events GROUP BY user_id")
def assembled_answers(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "delta").when(F.col("event_type") == "click", "reasoning").when(F.col("event_type") == "purchase", "usage").otherwise("done")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind.isin("delta", "reasoning"), F.col("props")).alias("content"), F.when(kind == "usage", F.col("event_id")).alias("total_tokens"))
    return chat.assemble(e)


@query("SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def tool_arguments(spark, sf_dir):
    k = F.col("event_id")
    j = F.when(k % 3 == 0, F.concat(F.lit('{"a":'), k.cast("string"), F.lit(',"b":null}'))).when(k % 3 == 1, F.lit('{"a":1}')).when(k % 2 == 0, F.lit("[1]")).otherwise("{")
    return read(spark, sf_dir, "events").select("event_id", chat.arguments_ok(j, ["a", "b"]).alias("ok"))


# sources and streams


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def json_lines(spark, sf_dir):
    path = folder(spark, f"orders-jsonl-{uuid.uuid4().hex}")
    read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").write.mode("overwrite").json(path)
    return readers.jsonl(spark, path, "o_orderkey long, o_orderpriority string")


@query("SELECT CAST(r_regionkey AS INTEGER) AS pos, r_name AS id, CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS INTEGER) AS models FROM region")
def catalogue_round_trip(spark, sf_dir):
    path = folder(spark, f"catalogue-{uuid.uuid4().hex}")
    readers.write_catalogue(providers(spark, sf_dir), path)
    return readers.catalogue(spark, path, lines=True).select("pos", "id", F.size("models").alias("models"))


@query(f"WITH {NODES_SQL}, {SUPPLIES_SQL} SELECT 'edge' AS kind, id, weight FROM (SELECT id, round(weight, 6) AS weight FROM edges) UNION ALL SELECT 'node', id, importance FROM nodes")
def copied_graph(spark, sf_dir):
    path = folder(spark, f"graph-{uuid.uuid4().hex}")
    readers.copy_graph(nodes(spark, sf_dir), supplies(spark, sf_dir), path)
    n, e = readers.read_graph(spark, path)
    return e.select(F.lit("edge").alias("kind"), "id", F.round("weight", 6).alias("weight")).unionByName(n.select(F.lit("node").alias("kind"), "id", F.col("importance").alias("weight")))


@query("SELECT n_name AS id FROM nation UNION ALL SELECT r_name FROM region")
def listed_models(spark, sf_dir):
    n = read(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("name"))).alias("models"))).alias("a"))
    r = read(spark, sf_dir, "region").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_name").alias("id"))).alias("data"))).alias("b"))
    return readers.model_list(n, "a", "ollama").unionByName(readers.model_list(r, "b", "openai"))


@query("SELECT n_name AS key, 'it''s ' || n_nationkey || ' \\$x' AS value FROM nation")
def dotenv_values(spark, sf_dir):
    path = folder(spark, f"env-{uuid.uuid4().hex}")
    n = read(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("it's "), F.col("n_nationkey").cast("string"), F.lit(" \\$x")).alias("v"))
    n.select(F.concat(F.lit("export "), "n_name", F.lit("="), json_text.shell_encode("v")).alias("value")).write.mode("overwrite").text(path)
    return readers.dotenv(spark, path)


def _live(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """A table as a stream of its files, which stand in a folder of their own."""
    path, rows = folder(spark, f"live-{name}-{uuid.uuid4().hex}"), read(spark, sf_dir, name).select(columns)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _streamed(spark: SparkSession, stream: DataFrame, what: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder."""
    path = folder(spark, f"{what}-{uuid.uuid4().hex}")
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(f"SELECT doc_id, sensitivity FROM {DLP_SQL}")
def guarded_stream(spark, sf_dir):
    return _streamed(spark, guard.guard(_live(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", "sensitivity"), "guarded")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'delta' ELSE 'reasoning' END AS kind, props AS content FROM events WHERE event_type IN ('view', 'click')")
def decoded_stream(spark, sf_dir):
    live = _live(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    part = lambda name: F.to_json(F.struct(F.array(F.struct(F.struct(F.col("props").alias(name)).alias("delta"))).alias("choices")))
    body = F.when(F.col("event_type") == "view", part("content")).when(F.col("event_type") == "click", part("reasoning_content")).otherwise("[DONE]")
    lines = live.select("event_id", F.concat(F.lit("data: "), body).alias("value"))
    return _streamed(spark, guard.decode_events(lines).select("event_id", "kind", "content"), "decoded")


@query("SELECT user_id AS stream_id, coalesce(string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'view'), '') AS content, max(event_id) AS total_tokens, true AS done FROM events GROUP BY user_id")
def accumulated_stream(spark, sf_dir):
    """Each user's views as one answer, closed by an end that comes after all of them."""
    live = _live(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "props"])
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    rows = live.join(last, "user_id").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "delta").otherwise("usage").alias("kind"), F.col("props").alias("content"), F.col("event_id").alias("total_tokens"), "last")
    own = F.struct("seq", "kind", "content", "total_tokens")
    end = F.struct((F.col("seq") + 1).alias("seq"), F.lit("done").alias("kind"), F.lit("").alias("content"), F.lit(None).cast("long").alias("total_tokens"))
    events = rows.select("stream_id", F.explode(F.when(F.col("seq") == F.col("last"), F.array(own, end)).otherwise(F.array(own))).alias("e")).select("stream_id", "e.*")
    return _streamed(spark, guard.accumulate(events).select("stream_id", "content", "total_tokens", "done"), "answers")
