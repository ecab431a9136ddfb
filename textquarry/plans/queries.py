"""Registered queries of the library's operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import chunk, dlp, json_text, text, vector
from textquarry.operators import algorithms, catalog, chat, recall, search, traversal, vectors
from textquarry.operators import graph_store as g
from textquarry.plans.rounds import cut

NOW = "2024-03-01T00:00:00Z"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the graph that the tables stand for: documents are nodes, supplies are weighted edges, a source's documents form chains


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tags = F.array_compact(F.array(F.col("lang"), F.when(F.col("doc_id") % 11 == 0, "stale"), F.when(F.col("doc_id") % 7 == 0, "pinned")))
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("type"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("body"), tags.alias("tags"), F.array("source").alias("projects"),
        F.array().cast("array<string>").alias("agents"), at.alias("created"), at.alias("updated"), (0.1 + (F.col("doc_id") % 10) * 0.08).alias("importance"), (F.col("doc_id") % 40).alias("access_count"),
        F.lit("").alias("accessed_at"), F.when(F.col("doc_id") % 5 == 0, at).otherwise("").alias("valid_until"), F.lit("").alias("last_verified"),
    )


NODES_SQL = """nodes AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS type, left(text, 60) AS title, text AS body,
  list_filter([lang, CASE WHEN doc_id % 11 = 0 THEN 'stale' END, CASE WHEN doc_id % 7 = 0 THEN 'pinned' END], lambda x: x IS NOT NULL) AS tags, [source] AS projects,
  strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS created, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS updated,
  0.1::DOUBLE + (doc_id % 10) * 0.08::DOUBLE AS importance, doc_id % 40 AS access_count, '' AS accessed_at,
  CASE WHEN doc_id % 5 = 0 THEN strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS valid_until FROM documents)"""


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg((F.avg("l_quantity") / 50).alias("weight"))
    s, p = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    return line.select(F.concat(s, F.lit("-"), p).alias("id"), s.alias("source"), p.alias("target"), F.lit("supplies").alias("relation"), "weight", F.lit("").alias("ts"))


SUPPLIES_SQL = """edges AS (SELECT 's' || l_suppkey || '-p' || l_partkey AS id, 's' || l_suppkey AS source, 'p' || l_partkey AS target, 'supplies' AS relation, avg(l_quantity) / 50 AS weight
  FROM lineitem GROUP BY l_suppkey, l_partkey)"""


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supplies(spark, sf_dir)
    return e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in a row, so one chain for each customer."""
    o = read(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = o.select(before.alias("a"), F.col("o_orderkey").alias("b")).filter("a is not null")
    return pairs.select(F.concat_ws("-", "a", "b").alias("id"), F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), F.lit("next").alias("relation"), (0.5 + (F.col("b") % 5) * 0.1).alias("weight"), F.lit("").alias("ts"))


CHAINS_SQL = """pairs AS (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, o_orderkey AS b FROM orders),
chain AS (SELECT a || '-' || b AS id, CAST(a AS VARCHAR) AS source, CAST(b AS VARCHAR) AS target, 0.5::DOUBLE + (b % 5) * 0.1::DOUBLE AS weight FROM pairs WHERE a IS NOT NULL)"""


def chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("pos"))


def _n(cls: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '[{cls}]', '', 'g')))"


TOKENS_SQL = f"""(SELECT doc_id, lang, CASE WHEN s = 0 THEN 0 ELSE greatest(1, CAST(round(s) AS INTEGER)) END AS tokens FROM (SELECT doc_id, lang,
  (length(t) - {_n(text.ONE)} - {_n(text.ONE_AND_HALF)} - {_n(text.TWO)} - {_n(text.CONTROL)}) / 4.0::DOUBLE + {_n(text.ONE)} + {_n(text.ONE_AND_HALF)} / 1.5::DOUBLE + {_n(text.TWO)} / 2.0::DOUBLE AS s
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)))"""


@query(f"SELECT lang, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS most FROM {TOKENS_SQL} GROUP BY lang")
def token_stats_by_lang(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", text.estimate_tokens("text").alias("tokens"))
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("tokens").cast("long").alias("tokens"), F.max("tokens").alias("most"))


@query(f"SELECT doc_id, tokens, greatest(tokens, 500) AS at_least FROM {TOKENS_SQL}")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"), text.estimate_tokens_min("text", 500).alias("at_least"))


_Q = lambda s: s.replace("'", "''")


@query(
    f"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '{_Q(text.SECRET)}', '\\1****', 'g')) AS masked, md5(regexp_replace(coalesce(text, ''), '{text.UNSAFE}', '', 'g')) AS clean, "
    f"md5(regexp_replace(coalesce(text, ''), '{text.ANSI}', '', 'g')) AS plain FROM documents"
)
def masked_texts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.mask_secrets(t)).alias("masked"), F.md5(text.sanitize_output(t)).alias("clean"), F.md5(text.strip_ansi(t)).alias("plain"))


@query(
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '(?i){_Q('|'.join(f'(?:{p})' for p in ps))}') THEN '{label}'" for label, ps in text.FAILURES)
    + " ELSE 'unknown' END AS failure FROM documents"
)
def failure_classes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.classify_failure("text").alias("failure"))


_HIT = [f"regexp_matches(coalesce(text, ''), '(?i){_Q(p)}')" for _, _, p in text.INJECTIONS]


@query(
    "SELECT doc_id, least(round(" + " + ".join(f"(CASE WHEN {h} THEN {w}::DOUBLE ELSE 0 END)" for h, (_, w, _) in zip(_HIT, text.INJECTIONS, strict=True)) + ", 4), 1.0::DOUBLE) AS score, concat_ws(',', "
    + ", ".join("CASE WHEN " + " OR ".join(h for h, r in zip(_HIT, text.INJECTIONS, strict=True) if r[0] == label) + f" THEN '{label}' END" for label in dict.fromkeys(r[0] for r in text.INJECTIONS))
    + ") AS labels FROM documents"
)
def injection_signals(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.injection_score("text").alias("score"), F.array_join(text.injection_labels("text"), ",").alias("labels"))


_RULE = {n: f"regexp_matches(coalesce(text, ''), '{_Q(p)}')" for n, _, _, p, _ in dlp.RULES}
_SEV = lambda s: " OR ".join(_RULE[r[0]] for r in dlp.RULES if r[2] == s)
DLP_SQL = (
    "(SELECT doc_id, source, concat_ws(',', " + ", ".join(f"CASE WHEN {h} THEN '{n}' END" for n, h in _RULE.items()) + f") AS rules, CASE WHEN {_SEV('critical')} THEN 'restricted' WHEN {_SEV('high')} THEN 'confidential' "
    f"WHEN {_SEV('medium')} THEN 'internal' ELSE 'public' END AS sensitivity FROM documents)"
)


@query(f"SELECT doc_id, rules, sensitivity FROM {DLP_SQL}")
def dlp_sensitivity(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("hits", dlp.rule_hits("text"))
    return d.select("doc_id", F.array_join("hits", ",").alias("rules"), dlp.sensitivity(F.col("hits")).alias("sensitivity"))


@query(f"SELECT doc_id, CASE WHEN source = 'src0' OR sensitivity = 'public' THEN 'allow' WHEN sensitivity = 'restricted' THEN 'block' WHEN sensitivity = 'confidential' THEN 'reroute' ELSE 'warn' END AS action, CASE WHEN source <> 'src0' AND sensitivity = 'confidential' THEN 'ollama' END AS provider FROM {DLP_SQL}")
def policy_actions(spark, sf_dir):
    """Documents of src0 go to a local model, the others to a hosted one."""
    d = read(spark, sf_dir, "documents").withColumn("level", dlp.sensitivity(dlp.rule_hits("text")))
    a = dlp.lookup(dlp.default_policy(F.when(F.col("source") == "src0", "local").otherwise("hosted")), F.col("level"))
    return d.select("doc_id", a["kind"].alias("action"), a["provider"].alias("provider"))


def _rule_sql(nth: int, rule: tuple) -> str:
    """Matches of one rule in bytes: between them stand the pieces that the pattern splits the text into."""
    name, category, severity, pattern, group = rule
    p = _Q(pattern)
    hit = f"regexp_extract_all(t, '{p}', 0)"
    part = f"regexp_extract_all(t, '{p}', 1)" if group else hit
    return f"""SELECT doc_id, '{category}' AS category, '{name}' AS rule, '{severity}' AS severity, {nth} AS nth, CAST(upto - strlen(part) AS INTEGER) AS start, CAST(upto AS INTEGER) AS "end" FROM (
  SELECT doc_id, part, sum(strlen(gap) + strlen(hit)) OVER (PARTITION BY doc_id ORDER BY i) - (strlen(hit) - strlen(part) - coalesce(nullif(strpos(hit, part), 0) - 1, 0)) * {int(group)} AS upto FROM (
  SELECT doc_id, unnest({hit}) AS hit, unnest({part}) AS part, unnest(regexp_split_to_array(t, '{p}')[1:len({hit})]) AS gap, unnest(range(len({hit}))) AS i FROM t WHERE regexp_matches(t, '{p}')))"""


_FOUND = "t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (" + " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(dlp.RULES)) + ")"


@query(f'WITH {_FOUND} SELECT doc_id, category, rule, severity, start, "end" FROM found')
def dlp_findings(spark, sf_dir):
    return dlp.findings(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""WITH {_FOUND}, o AS (SELECT doc_id, start AS a, "end" AS b, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o),
i AS (SELECT doc_id, island, min(a) AS a, max(b) AS b FROM g GROUP BY ALL), k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM i),
r AS (SELECT doc_id, string_agg(decode(encode(t)[prev + 1:a]) || '****', '' ORDER BY a) AS head, max(b) AS last FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN head IS NULL THEN t ELSE head || decode(encode(t)[last + 1:]) END) AS redacted FROM t LEFT JOIN r USING (doc_id)""")
def dlp_redacted(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(dlp.redacted("text"), F.lit(""))).alias("redacted"))


def _in(cls: str) -> str:
    return f"(length(u) - length(regexp_replace(u, '[{cls}]', '', 'g')))"


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?。！？])', '\\1\n', 'g'), '[\r\n]'), lambda x: regexp_replace(x, '^[{0}]+|[{0}]+$', '', 'g')), lambda x: x <> '')".format(text.WHITE)
_SIZE = "(CASE WHEN {s} = 0 THEN 0 ELSE greatest(1, CAST(round({s}) AS BIGINT)) END)".format(s="((b.q - a.q0 + b.i - a.i) / 4.0::DOUBLE + (b.m - a.m0) / 1.5::DOUBLE)")


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES} AS us FROM documents), e AS (SELECT doc_id, unnest(us) AS u, unnest(range(len(us))) AS i FROM s),
w AS (SELECT doc_id, i, u, {_in(text.ONE_AND_HALF)} AS mid, length(u) - {_in(text.ONE_AND_HALF)} - {_in(text.CONTROL)} + 3 * {_in(text.ONE)} + {_in(text.TWO)} AS qu FROM e),
p AS MATERIALIZED (SELECT doc_id, i, u, q, m, q - qu AS q0, m - mid AS m0 FROM (SELECT *, sum(qu) OVER x AS q, sum(mid) OVER x AS m FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i))),
pairs AS MATERIALIZED (SELECT a.doc_id, a.i AS a, b.i AS b, {_SIZE} AS size FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i >= a.i AND (b.i = a.i OR b.q - a.q0 + b.i - a.i <= 2056)),
lasts AS MATERIALIZED (SELECT doc_id, a, max(CASE WHEN size <= 512 THEN b END) AS last FROM pairs GROUP BY doc_id, a),
ends AS MATERIALIZED (SELECT doc_id, a, coalesce(last, a) AS last FROM lasts),
carry AS MATERIALIZED (SELECT doc_id, b, min(a) AS a FROM pairs WHERE size <= 64 GROUP BY ALL),
nexts AS MATERIALIZED (SELECT t.doc_id, t.a, t.last, CASE WHEN t.last = t.a THEN t.last + 1 WHEN coalesce(c.a, t.last) <= t.a OR coalesce(c.a, t.last) = t.last THEN CASE WHEN n.size IS NULL OR n.size > 512 THEN t.last + 1 ELSE t.last END ELSE c.a END AS next
  FROM ends t LEFT JOIN carry c ON c.doc_id = t.doc_id AND c.b = t.last LEFT JOIN pairs n ON n.doc_id = t.doc_id AND n.a = t.last AND n.b = t.last + 1),
top AS (SELECT doc_id, max(i) AS top FROM p GROUP BY doc_id),
k AS (SELECT doc_id, 0::BIGINT AS a, 0 AS nth FROM top UNION ALL SELECT k.doc_id, x.next, nth + 1 FROM k JOIN nexts x ON x.doc_id = k.doc_id AND x.a = k.a JOIN top ON top.doc_id = k.doc_id WHERE x.last < top)
SELECT k.doc_id, CAST(nth AS INTEGER) AS nth, array_to_string(us[k.a + 1:x.last + 1], ' ') AS chunk, CAST(z.size AS INTEGER) AS tokens FROM k JOIN nexts x ON x.doc_id = k.doc_id AND x.a = k.a JOIN s ON s.doc_id = k.doc_id JOIN pairs z ON z.doc_id = k.doc_id AND z.a = k.a AND z.b = x.last""")
def chunks(spark, sf_dir):
    d = chunk.chunk_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 512, 64)
    return d.withColumn("tokens", text.estimate_tokens("chunk"))



@query(f"SELECT doc_id, len({_SENTENCES}) AS sentences, md5(array_to_string({_SENTENCES}, '|')) AS joined FROM documents")
def sentences(spark, sf_dir):
    s = text.segment(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.md5(F.array_join(s, "|")).alias("joined"))


@query("SELECT page_id, CASE WHEN length(url) <= 8 THEN '****' ELSE left(url, 4) || '****' || right(url, 4) END AS redacted, CASE WHEN length(url) > 64 THEN left(url, 64) || '…' ELSE url END AS preview, regexp_matches(substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-4' || substr(md5(url), 13, 3) || '-' || substr(md5(url), 16, 4) || '-' || substr(md5(url), 20, 12), '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS uuid4 FROM pages")
def small_scalars(spark, sf_dir):
    m = F.md5("url")
    u = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.concat(F.lit("4"), F.substring(m, 13, 3)), F.substring(m, 16, 4), F.substring(m, 20, 12))
    return read(spark, sf_dir, "pages").select("page_id", text.redact_credential("url").alias("redacted"), text.text_preview("url").alias("preview"), text.is_uuid4(u).alias("uuid4"))


@query("SELECT event_id, 'User ' || user_id || ' did ' || event_type || ': ' || user_id AS prompt, 'who,what' AS variables FROM events")
def rendered_prompts(spark, sf_dir):
    tpl = F.lit("User {{who}} did {{what}}: {{who}}")
    e = read(spark, sf_dir, "events")
    return e.select("event_id", text.render_prompt(tpl, {"who": F.col("user_id").cast("string"), "what": F.col("event_type")}).alias("prompt"), F.array_join(text.template_variables(tpl), ",").alias("variables"))


@query("SELECT event_id, props AS found, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'ok' AS status, event_type AS kind FROM events")
def extracted_json(spark, sf_dir):
    answer = F.concat(F.lit("Sure:\n<kind> "), F.col("event_type"), F.lit(" </kind>\n```json\n"), F.col("props"), F.lit("\n```\ndone {"))
    e = read(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    e = e.select("event_id", json_text.extract_json("answer").alias("found"), json_text.parse_json("answer", "k long").alias("p"), text.extract_xml_tag("answer", "kind").alias("kind"))
    return e.select("event_id", "found", "p.value.k", "p.status", "kind")


# retrieval


@query("SELECT doc_id, CAST((length(t) - length(replace(t, 'with', ''))) / 4 + (length(t) - length(replace(t, 'token', ''))) / 5 AS BIGINT) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'with') OR contains(t, 'token') ORDER BY score DESC, doc_id LIMIT 20")
def keyword_top(spark, sf_dir):
    return search.keyword_search(read(spark, sf_dir, "documents"), "With token", 20, pos="doc_id").select("doc_id", "score")


def _tf(c: str, q: str) -> str:
    return f"(CASE WHEN contains(lower({c}), '{q}') THEN len(list_filter(range(1, greatest(2, length({c}) - {len(q)} + 2)), lambda i: substr(lower({c}), i, {len(q)}) = '{q}')) ELSE 0 END)"


def _bm25_sql(q: str) -> str:
    return f"""WITH {NODES_SQL}, r AS (SELECT id, importance, updated, access_count, {_tf('title', q)} + {_tf('body', q)} + {_tf("array_to_string(tags, ',')", q)} AS tf,
  greatest(length(title) - 2, 0) + greatest(length(body) - 2, 0) + greatest(length(array_to_string(tags, ',')) - 2, 0) AS d, tags FROM nodes),
  st AS (SELECT count(*) AS n, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS m, avg(d) AS a FROM r),
  hits AS (SELECT id, importance, updated, access_count, tags, -(CASE WHEN ln((n - m + 0.5::DOUBLE) / (m + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - m + 0.5::DOUBLE) / (m + 0.5::DOUBLE)) END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / a)) AS bm25 FROM r, st WHERE tf > 0)"""


@query(_bm25_sql("license") + " SELECT id, round(bm25, 6) AS bm25 FROM hits ORDER BY hits.bm25, importance DESC, id LIMIT 50")
def bm25_top(spark, sf_dir):
    return search.bm25_search(nodes(spark, sf_dir), "license", 50).select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {NODES_SQL} SELECT id, importance FROM nodes WHERE (contains(lower(title), 'token') OR contains(lower(body), 'token') OR contains(lower(array_to_string(tags, ',')), 'token')) AND (contains(lower(title), 'en') OR contains(lower(body), 'en') OR contains(lower(array_to_string(tags, ',')), 'en')) ORDER BY importance DESC, id LIMIT 50")
def terms_top(spark, sf_dir):
    return search.terms_search(nodes(spark, sf_dir), "Token en", 50).select("id", "importance")


@query(_bm25_sql("license") + ", a AS (SELECT id, bm25, importance FROM hits ORDER BY bm25, importance DESC, id LIMIT 30), b AS (SELECT id, 0.0 AS bm25, importance FROM (SELECT * FROM nodes WHERE contains(lower(title), 'license') OR contains(lower(body), 'license') OR contains(lower(array_to_string(tags, ',')), 'license') ORDER BY importance DESC, id LIMIT 30) WHERE id NOT IN (SELECT id FROM a)) SELECT id FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 AS s FROM b ORDER BY s, bm25, importance DESC, id LIMIT 30)")
def hybrid_top(spark, sf_dir):
    return search.hybrid_search(nodes(spark, sf_dir), "license", 30).select("id")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each event type: users by the sum of their values."""
    e = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("score"))
    return search.with_rank(e.select(F.lit("all").alias("query_id"), F.col("event_type").alias("list_id"), F.col("user_id").alias("id"), F.coalesce("score", F.lit(0.0)).alias("score")))


LISTS_SQL = "lists AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, id) AS pos FROM (SELECT event_type AS list_id, user_id AS id, coalesce(round(sum(value), 4), 0.0) AS score FROM events GROUP BY ALL))"
_WEIGHTS = {"view": 0.5, "signup": 2.0, "error": 0.1, "click": 1.0, "purchase": 3.0}
_W = "CASE list_id " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _WEIGHTS.items()) + " END"
_NORM = "norm AS (SELECT *, CASE WHEN hi - lo < 1.1920929e-07 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS unit FROM (SELECT *, min(score) OVER (PARTITION BY list_id) AS lo, max(score) OVER (PARTITION BY list_id) AS hi FROM lists))"


@query(f"WITH {LISTS_SQL}, {_NORM} SELECT l.id, round(l.rrf, 8) AS rrf, round(l.weighted, 8) AS weighted, round(n.s, 8) AS weighted_sum, round(m.mnz, 6) AS comb_mnz FROM (SELECT id, sum(1.0::DOUBLE / (60 + pos)) AS rrf, sum({_W} / (60 + pos)) AS weighted FROM lists GROUP BY id) l JOIN (SELECT id, sum({_W} * unit) AS s FROM norm GROUP BY id) n USING (id) JOIN (SELECT id, sum(score) * sum(CASE WHEN pos <= 10 THEN 1 ELSE 0 END) AS mnz FROM lists GROUP BY id) m USING (id)")
def rank_fusion(spark, sf_dir):
    ranked = lists(spark, sf_dir)
    one = lambda df, name, digits: df.select("id", F.round("score", digits).alias(name))
    out = one(search.rrf(ranked), "rrf", 8).join(one(search.rrf(ranked, weights=_WEIGHTS), "weighted", 8), "id")
    return out.join(one(search.weighted_sum(search.normalize_minmax(ranked), _WEIGHTS), "weighted_sum", 8), "id").join(one(search.comb_mnz(ranked, 10), "comb_mnz", 6), "id")


@query(f"WITH {LISTS_SQL} SELECT id, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT id, sum(1.0::DOUBLE / (60 + pos)) AS score FROM lists WHERE pos <= 40 GROUP BY id) QUALIFY rank <= 20")
def federated_top(spark, sf_dir):
    """Each event type is a backend; all are asked for 40 users and 20 stay."""
    ranked = lists(spark, sf_dir)
    backends = {t: ranked.filter(F.col("list_id") == t).select("query_id", "id", "score") for t in _WEIGHTS}
    return search.federate(backends, 20).select("id", F.round("score", 8).alias("score"), F.col("rank").cast("int").alias("rank"))


_COS = "(CASE WHEN list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) > 0 THEN list_cosine_similarity(q.embedding::DOUBLE[], a.embedding::DOUBLE[]) ELSE 0 END)"


@query(f"SELECT q.vec_id AS query_id, a.vec_id AS id, round({_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, a.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings a WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5")
def knn_top(spark, sf_dir):
    """The stated query set is every vector whose id 50 divides."""
    e = read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.knn(e, q, 5, id_="vec_id", vector="embedding").select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"SELECT q.vec_id AS query_id, a.vec_id AS id, round((1 + {_COS}) / 2, 6) AS score FROM embeddings q, embeddings a WHERE q.vec_id % 50 = 0 AND a.label = q.label AND a.label <> 3 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, a.vec_id) <= 5")
def knn_filtered_top(spark, sf_dir):
    """Within the query's label, among an allowed list, with the score of stores that have no negative ones."""
    e = read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    hits = vectors.knn_filtered(e, q, 5, e.filter("label <> 3").select("vec_id"), id_="vec_id", vector="embedding", same=["label"])
    return hits.select("query_id", "id", F.round(vectors.half_cosine("score"), 6).alias("score"))


_SPARSE = "sparse AS (SELECT vec_id, i, v FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings) WHERE v <> 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) <= 8)"


@query(f"WITH {_SPARSE}, s AS (SELECT q.vec_id AS query_id, a.vec_id AS id, sum(q.v::DOUBLE * a.v::DOUBLE) AS score FROM sparse q JOIN sparse a USING (i) WHERE q.vec_id % 50 = 0 GROUP BY ALL) SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5")
def sparse_top(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), vector.prune_top_k(vector.sparse(F.sequence(F.lit(1), F.size("embedding")), "embedding"), 8).alias("vector"))
    return vectors.sparse_search(rows, rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 5).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"SELECT a.vec_id AS id, max_by(q.vec_id, {_COS}) AS match, round(max({_COS}), 6) AS score FROM embeddings q, embeddings a WHERE q.vec_id % 50 = 0 GROUP BY a.vec_id HAVING max({_COS}) >= 0.85")
def fingerprints(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    found = vectors.fingerprint(e, e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "match"), id_="vec_id", vector="embedding")
    return found.select("id", "match", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def vector_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm("embedding"), 5).alias("norm"), F.round(vector.norm(vector.normalize("embedding")), 5).alias("unit"))


# graph store


@query(f"WITH {NODES_SQL}, {SUPPLIES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT round(avg(importance), 2) FROM nodes) AS avg_importance, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM nodes GROUP BY type)) AS by_type")
def graph_stats(spark, sf_dir):
    s = g.stats(nodes(spark, sf_dir), supplies(spark, sf_dir))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select("nodes", "edges", "avg_importance", types.alias("by_type"))


@query(f"WITH {NODES_SQL} SELECT id, created, importance FROM nodes WHERE list_contains(tags, 'en') AND list_contains(projects, 'src3') AND created >= '2024-01-05T00:00:00Z' AND created < '2025-06-01T00:00:00Z' ORDER BY importance DESC, id LIMIT 30 OFFSET 5")
def node_query(spark, sf_dir):
    q = g.NodeQuery(tag="en", project="src3", since="2024-01-05T00:00:00Z", until="2025-06-01T00:00:00Z", order="importance_desc", limit=30, offset=5)
    return g.query_nodes(nodes(spark, sf_dir), q).select("id", "created", "importance")


@query(f"WITH {SUPPLIES_SQL} SELECT id, round(sum(w), 6) AS weight FROM (SELECT target AS id, weight AS w FROM edges WHERE source IN ('s1', 's2', 'p5') UNION ALL SELECT source, weight FROM edges WHERE target IN ('s1', 's2', 'p5')) WHERE id NOT IN ('s1', 's2', 'p5') GROUP BY id")
def weighted_neighbors(spark, sf_dir):
    seeds = spark.createDataFrame([("s1",), ("s2",), ("p5",)], "id string")
    return traversal.neighbors(supplies(spark, sf_dir), seeds).select("id", F.round("weight", 6).alias("weight"))


@query(f"WITH {SUPPLIES_SQL} SELECT id, target, round(weight, 6) AS weight FROM edges WHERE source = 's3'")
def edges_out(spark, sf_dir):
    return g.edges_of(supplies(spark, sf_dir), "s3", g.Direction.OUT).select("id", "target", F.round("weight", 6).alias("weight"))


@query(f"WITH {SUPPLIES_SQL}, chosen AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size < 10) SELECT id FROM edges WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen)")
def induced_edges(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").filter("s_nationkey < 5").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    p = read(spark, sf_dir, "part").filter("p_size < 10").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return g.edges_among(supplies(spark, sf_dir), s.unionByName(p)).select("id")


_LIFE = "(accessed_at < '2024-01-31T00:00:00Z' OR accessed_at = '') AND updated < '2024-01-31T00:00:00Z'"


@query(f"WITH {NODES_SQL} SELECT id, round(CASE WHEN {_LIFE} AND importance > 0.2 AND NOT list_contains(tags, 'pinned') THEN greatest(0.2, importance * 0.9) ELSE importance END, 6) AS importance, array_to_string(CASE WHEN updated < '2024-01-31T00:00:00Z' AND NOT list_contains(tags, 'stale') THEN list_append(tags, 'stale') ELSE tags END, ',') AS tags, valid_until <> '' AND valid_until < '{NOW}' AS expired FROM nodes")
def lifecycle(spark, sf_dir):
    n = g.tag_stale(g.decay_importance(nodes(spark, sf_dir), 30, 0.9, 0.2, NOW), 30, NOW)
    return n.select("id", F.round("importance", 6).alias("importance"), F.array_join("tags", ",").alias("tags"), ((F.col("valid_until") != "") & (F.col("valid_until") < NOW)).alias("expired"))


@query(f"WITH {NODES_SQL} SELECT id, title, CASE WHEN doc_id IS NULL THEN created ELSE created END AS created, CASE WHEN doc_id IS NOT NULL THEN 'revised' ELSE type END AS type, greatest(access_count, coalesce(k, 0)) AS access_count FROM nodes LEFT JOIN (SELECT doc_id, 20 AS k FROM labels GROUP BY doc_id) ON id = CAST(doc_id AS VARCHAR)")
def upserted_nodes(spark, sf_dir):
    """Labelled documents come again as revised nodes that were read 20 times."""
    n = nodes(spark, sf_dir)
    labelled = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct()
    again = n.join(labelled, "id", "left_semi").withColumns({"type": F.lit("revised"), "created": F.lit("2030"), "access_count": F.lit(20).cast("long"), "seq": F.lit(1)})
    return g.upsert_nodes(n, again).select("id", "title", "created", "type", "access_count")


@query(f"WITH {SUPPLIES_SQL} SELECT source, target, relation FROM edges UNION SELECT 's' || l_suppkey, 'p' || l_partkey, 'returned' FROM lineitem WHERE l_returnflag = 'R'")
def appended_edges(spark, sf_dir):
    """Every line as an edge again: supplies are known, returns are new once for each pair."""
    line = read(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    returned = F.col("l_returnflag") == "R"
    rows = line.select(F.concat_ws("-", s, p, F.when(returned, "returned")).alias("id"), s.alias("source"), p.alias("target"), F.when(returned, "returned").otherwise("supplies").alias("relation"), F.lit(1.0).alias("weight"), F.lit("").alias("ts"), F.col("l_orderkey").alias("seq"))
    return g.append_edges(supplies(spark, sf_dir), rows).select("source", "target", "relation")


@query(f"WITH {NODES_SQL} SELECT title, max_by(id, updated || id) AS id FROM nodes WHERE updated > '2024-01-15T00:00:00Z' GROUP BY title")
def recent_titles(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return g.duplicates(n, n.select("title"), 46 * 24, NOW).select("title", "id")


_RECALL = """least(greatest(access_count, 0) / 20.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + 0.35::DOUBLE * importance + 0.20::DOUBLE * (CASE WHEN updated > '{0}' THEN 0.5::DOUBLE
  ELSE exp(-date_diff('second', strptime(updated, '%Y-%m-%dT%H:%M:%SZ'), TIMESTAMP '2024-03-01') / 86400.0::DOUBLE * ln(2.0::DOUBLE) / 30) END)""".format(NOW)


@query(f"WITH {NODES_SQL} SELECT id, round({_RECALL}, 6) AS score FROM (SELECT * FROM nodes WHERE NOT list_contains(tags, 'stale') AND list_contains(projects, 'src5') ORDER BY importance DESC, updated DESC, id LIMIT 80) ORDER BY {_RECALL} DESC, id LIMIT 20")
def recall_candidates(spark, sf_dir):
    o = recall.RecallOptions(limit=20, scope=g.NodeQuery(project="src5"))
    return recall.candidates(nodes(spark, sf_dir), o, NOW).select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql("license") + f", m AS (SELECT * FROM hits ORDER BY bm25, importance DESC, id LIMIT 80) SELECT id, round({_RECALL} + 0.2::DOUBLE, 6) AS score FROM m WHERE NOT list_contains(tags, 'stale') ORDER BY {_RECALL} DESC, id LIMIT 20")
def recall_hinted(spark, sf_dir):
    o = recall.RecallOptions(hint="license", limit=20)
    return recall.candidates(nodes(spark, sf_dir), o, NOW).select("id", F.round("score", 6).alias("score"))


_BEST = f"""{NODES_SQL}, best AS MATERIALIZED (SELECT id, type, {_RECALL} AS score FROM (SELECT * FROM nodes WHERE NOT list_contains(tags, 'stale') ORDER BY importance DESC, updated DESC, id LIMIT 200) ORDER BY {_RECALL} DESC, id LIMIT 50),
  next AS (SELECT lag(id) OVER (PARTITION BY type ORDER BY CAST(id AS BIGINT)) AS source, id AS target FROM nodes), ids AS (SELECT id FROM best), edges AS (SELECT source, target, 0.5::DOUBLE AS weight FROM next WHERE source IN (SELECT id FROM best) AND target IN (SELECT id FROM best))"""


def converged_sql(ctes: str, rounds: int) -> str:
    """PageRank over edges (source, target, weight) and ids (id), with every round as a table of its own, and the first that
    moves less than 1e-6 (or the last) chosen."""
    steps, tried = "", []
    for i in range(rounds):
        steps += f""", r{i + 1} AS MATERIALIZED (SELECT ids.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0.0) + lost / n) AS r FROM ids JOIN (SELECT count(*) AS n FROM ids) ON true
  JOIN (SELECT coalesce(sum(r), 0.0) AS lost FROM r{i} WHERE id NOT IN (SELECT source FROM total)) ON true LEFT JOIN (SELECT target AS id, sum(r * weight / t) AS got FROM r{i} JOIN edges ON edges.source = r{i}.id JOIN total ON total.source = r{i}.id GROUP BY target) gg ON gg.id = ids.id)"""
        tried.append(f"SELECT {i + 1} AS k, a.id, a.r, sum(abs(a.r - b.r)) OVER () AS moved FROM r{i + 1} a JOIN r{i} b USING (id)")
    return f"WITH {ctes}, total AS (SELECT source, sum(weight) AS t FROM edges GROUP BY source), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS r FROM ids){steps}, every AS ({' UNION ALL '.join(tried)}), chosen AS (SELECT coalesce(min(CASE WHEN moved < 1e-6 THEN k END), {rounds}) AS k FROM every)"


@query(converged_sql(_BEST, 40) + " SELECT id, round(score + 0.1::DOUBLE * r / max(r) OVER (), 6) AS score FROM best JOIN every USING (id) JOIN chosen USING (k)")
def recall_boosted(spark, sf_dir):
    n = nodes(spark, sf_dir)
    w = Window.partitionBy("type").orderBy(F.col("id").cast("long"))
    e = n.select(F.lag("id").over(w).alias("source"), F.col("id").alias("target")).filter("source is not null").select(F.concat_ws("-", "source", "target").alias("id"), "source", "target", F.lit("next").alias("relation"), F.lit(0.5).alias("weight"), F.lit("").alias("ts"))
    return recall.recall(n, e, recall.RecallOptions(limit=50), NOW).select("id", F.round("score", 6).alias("score"))


# traversal and algorithms


@query(f"WITH RECURSIVE {CHAINS_SQL}, both_ways AS (SELECT source AS a, target AS b FROM chain UNION ALL SELECT target, source FROM chain), start AS (SELECT CAST(min(o_orderkey) AS VARCHAR) AS id FROM orders), walk AS (SELECT id, 0 AS depth FROM start UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = id WHERE depth < 4) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id HAVING min(depth) > 0")
def related_orders(spark, sf_dir):
    start = str(read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0])
    return traversal.related(chains(spark, sf_dir), start, 4).select("id", F.col("depth").cast("int").alias("depth"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, min(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey) AS component FROM orders")
def order_components(spark, sf_dir):
    return algorithms.components(chain_nodes(spark, sf_dir), chains(spark, sf_dir))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS c, list(o_orderkey ORDER BY o_orderkey) AS ids, list(0.5::DOUBLE + (o_orderkey % 5) * 0.1::DOUBLE ORDER BY o_orderkey) AS w FROM orders GROUP BY o_custkey),
f AS (SELECT c, ids, w, ids AS label, 0 AS t FROM o UNION ALL
  SELECT c, ids, w, CASE WHEN new IS NULL THEN label ELSE list_transform(range(1, len(ids) + 1), lambda k: CASE WHEN k = i THEN new ELSE label[k] END) END, t + 1 FROM (
    SELECT *, CASE WHEN l IS NULL THEN r WHEN r IS NULL OR l = r THEN l WHEN w[i] > w[i + 1] OR w[i] = w[i + 1] AND l < r THEN l ELSE r END AS new FROM (
      SELECT *, CASE WHEN i > 1 THEN label[i - 1] END AS l, CASE WHEN i < len(ids) THEN label[i + 1] END AS r FROM (SELECT *, t % len(ids) + 1 AS i FROM f WHERE t < 10 * len(ids)))))
SELECT CAST(unnest(ids) AS VARCHAR) AS id, CAST(unnest(label) AS VARCHAR) AS label FROM f WHERE t = 10 * len(ids)""")
def order_labels(spark, sf_dir):
    return algorithms.label_propagation(chain_nodes(spark, sf_dir), chains(spark, sf_dir))


@query(f"WITH {SUPPLIES_SQL}, e AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges)) SELECT a AS id, count(*) AS degree FROM e GROUP BY a")
def node_degrees(spark, sf_dir):
    return algorithms.degrees(supplies(spark, sf_dir))


@query(f"WITH {SUPPLIES_SQL}, n AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges)), deg AS (SELECT a AS z, count(*) AS d FROM n GROUP BY a), pair AS (SELECT 's' || s1.s_suppkey AS a, 's' || s2.s_suppkey AS b FROM supplier s1, supplier s2 WHERE s2.s_suppkey = s1.s_suppkey + 1), c AS (SELECT pair.a, pair.b, count(*) AS common, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS aa FROM pair JOIN n x ON x.a = pair.a JOIN n y ON y.a = pair.b AND y.b = x.b JOIN deg ON deg.z = x.b GROUP BY ALL) SELECT pair.a, pair.b, coalesce(common, 0) AS common, round(CASE WHEN coalesce(da.d, 0) + coalesce(db.d, 0) - coalesce(common, 0) > 0 THEN coalesce(common, 0)::DOUBLE / (coalesce(da.d, 0) + coalesce(db.d, 0) - coalesce(common, 0)) ELSE 0.0 END, 6) AS jaccard, round(coalesce(aa, 0.0), 6) AS adamic_adar FROM pair LEFT JOIN c ON c.a = pair.a AND c.b = pair.b LEFT JOIN deg da ON da.z = pair.a LEFT JOIN deg db ON db.z = pair.b")
def supplier_similarity(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    pairs = s.join(s.select((F.col("s_suppkey") - 1).alias("s_suppkey")), "s_suppkey").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("a"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("b"))
    out = algorithms.similarity(supplies(spark, sf_dir), pairs)
    return out.select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"), F.round("adamic_adar", 6).alias("adamic_adar"))


@query(f"WITH {CHAINS_SQL}, n AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM chain UNION ALL SELECT target, source FROM chain)), deg AS (SELECT a AS z, count(*) AS d FROM n GROUP BY a), c AS (SELECT x.b AS a, y.b AS b, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS s FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN deg ON deg.z = x.a GROUP BY ALL) SELECT a, b, round(s, 6) AS score FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.a = c.a AND n.b = c.b) ORDER BY s DESC, a, b LIMIT 50")
def predicted_links(spark, sf_dir):
    return algorithms.link_prediction(chains(spark, sf_dir), 50).select("a", "b", F.round("score", 6).alias("score"))


@query(converged_sql(f"{SUPPLIES_SQL}, ids AS (SELECT source AS id FROM edges UNION SELECT target FROM edges)", 30) + " SELECT id, round(r / sum(r) OVER (), 8) AS rank FROM every JOIN chosen USING (k)")
def page_rank(spark, sf_dir):
    """With its defaults, to convergence."""
    edges = cut(supplies(spark, sf_dir).select("source", "target", "weight"), "supplies")  # the sum over lines, once
    ends = edges.select(F.col("source").alias("id")).distinct().unionByName(edges.select(F.col("target").alias("id")).distinct()).distinct()
    return algorithms.pagerank(ends, edges).select("id", F.round("rank", 8).alias("rank"))


@query(f"WITH RECURSIVE {CHAINS_SQL}, start AS (SELECT CAST(min(o_orderkey) AS VARCHAR) AS id FROM orders), walk AS (SELECT id, 0.0::DOUBLE AS dist FROM start UNION ALL SELECT target, dist - ln(least(weight, 1.0)) FROM walk JOIN chain ON source = walk.id) SELECT id, round(abs(min(dist)), 6) AS dist FROM walk GROUP BY id")
def order_distances(spark, sf_dir):
    start = str(read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0])
    return algorithms.distances(chains(spark, sf_dir), start).select("id", F.round(F.abs("dist"), 6).alias("dist"))


# conversations, catalogues, streams of events

_VALID = " OR ".join(f"({'p IS NULL' if a is None else f"p = '{a}'"} AND role IN ({', '.join(repr(r) for r in rs)}))" for a, rs in chat.AFTER.items())


@query(f"SELECT conv_id, turn, role, coalesce({_VALID}, false) AS valid FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)")
def role_transitions(spark, sf_dir):
    return chat.transitions(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.coalesce("valid", F.lit(False)).alias("valid"))


@query(f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS turn, NULL::VARCHAR AS role, NULL::BOOLEAN AS accepted, 0::BIGINT AS i, NULL::VARCHAR AS p FROM conversations
  UNION ALL SELECT conv_id, turn, role, ok, i, CASE WHEN ok THEN role ELSE p END FROM (SELECT q.conv_id, q.turn, q.role, q.i, f.p, ({_VALID.replace('role IN', 'q.role IN')}) AS ok FROM f JOIN q ON q.conv_id = f.conv_id AND q.i = f.i + 1))
SELECT conv_id, turn, role, accepted FROM f WHERE i > 0""")
def accepted_messages(spark, sf_dir):
    return chat.accept(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "accepted")


@query("SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS messages FROM " + TOKENS_SQL.replace("doc_id, lang", "conv_id").replace("FROM documents", "FROM conversations") + " GROUP BY conv_id")
def conversation_tokens(spark, sf_dir):
    return chat.token_counts(read(spark, sf_dir, "conversations"))


_COSTS = TOKENS_SQL.replace("doc_id, lang", "conv_id, turn, role, text").replace("coalesce(text, '') AS t FROM documents", "coalesce(text, '') AS t FROM conversations")


@query(f"""WITH c AS {_COSTS} SELECT conv_id, turn, role FROM (SELECT *, coalesce(role = 'system', false) AS held, sum(tokens) OVER (PARTITION BY conv_id)
  - coalesce(sum(CASE WHEN role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM c) WHERE held OR rest + 50 <= 200""")
def truncated_conversations(spark, sf_dir):
    return chat.truncate(read(spark, sf_dir, "conversations"), 200, 50).select("conv_id", "turn", "role")


@query("""SELECT conv_id, request, sha256('m1' || chr(0) || request) AS key FROM (SELECT conv_id, '{"model":"m1","temperature":0.7,' || coalesce('"system":' || to_json(min_by(text, turn) FILTER (role = 'system')) || ',', '') || '"messages":['
  || coalesce(string_agg('{"role":' || to_json(role) || coalesce(',"content":' || to_json(text), '') || '}', ',' ORDER BY turn) FILTER (role <> 'system'), '') || ']}' AS request FROM conversations GROUP BY conv_id)""")
def chat_requests(spark, sf_dir):
    r = chat.requests(read(spark, sf_dir, "conversations"), "m1")
    return r.select("conv_id", "request", chat.cache_key(F.lit("m1"), F.col("request")).alias("key"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'delta' WHEN 'click' THEN 'reasoning' WHEN 'purchase' THEN 'usage' ELSE 'done' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN props END AS content, CASE WHEN event_type = 'purchase' THEN CAST(user_id AS INTEGER) END AS total_tokens FROM events WHERE event_type <> 'error'")
def decoded_events(spark, sf_dir):
    """Events written as the lines of a model's answer and decoded again; errors stand for the end mark."""
    e = read(spark, sf_dir, "events")
    n = F.col("user_id").cast("int")
    delta = lambda name, finish=None: F.struct(F.array(F.struct(F.struct(F.col("props").alias(name)).alias("delta"), F.lit(finish).cast("string").alias("finish_reason"))).alias("choices"))
    usage = F.struct(F.array(F.struct(F.struct(F.lit("").alias("content")).alias("delta"))).alias("choices"), F.struct(n.alias("prompt_tokens"), n.alias("completion_tokens"), n.alias("total_tokens")).alias("usage"))
    end = F.struct(F.array(F.struct(F.struct(F.lit("").alias("content")).alias("delta"), F.lit("stop").alias("finish_reason"))).alias("choices"))
    kind = F.col("event_type")
    body = F.when(kind == "view", F.to_json(delta("content"))).when(kind == "click", F.to_json(delta("reasoning_content"))).when(kind == "purchase", F.to_json(usage)).when(kind == "error", "[DONE]").otherwise(F.to_json(end))
    out = e.select("event_id", chat.openai_event(chat.event_data(F.concat(F.lit("data: "), body))).alias("v")).filter("v is not null")
    return out.select("event_id", "v.kind", "v.content", "v.total_tokens")


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as providers and their parts' brands as models would be; here nations with regions' prices."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    price = F.struct((F.col("n_nationkey") + 1).cast("double").alias("input"), (F.col("n_nationkey") * 2.0).alias("output"), F.lit(None).cast("double").alias("cache_read"), F.lit(None).cast("double").alias("cache_write"))
    model = F.struct(
        F.col("n_name").alias("id"), F.lower("n_name").alias("name"), F.lit("f").alias("family"), F.lit("").alias("release_date"), F.lit("").alias("knowledge"), price.alias("cost"),
        F.struct((F.col("n_nationkey") * 1000).cast("long").alias("context"), F.lit(1).cast("long").alias("output")).alias("limit"),
        F.struct(F.array(F.lit("text"), F.when(F.col("n_nationkey") % 2 == 0, "image").otherwise("audio")).alias("input"), F.array(F.lit("text")).alias("output")).alias("modalities"),
        F.struct(F.lit(True).alias("attachment"), (F.col("n_nationkey") % 3 == 0).alias("reasoning"), F.lit(True).alias("temperature"), (F.col("n_nationkey") % 4 == 0).alias("tool_call"), F.lit(True).alias("streaming")).alias("capabilities"),
    )
    grouped = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(model)).alias("models"))
    return grouped.select(F.col("r_regionkey").cast("int").alias("pos"), F.col("r_name").alias("id"), F.col("r_name").alias("display_name"), F.when(F.col("r_regionkey") < 2, "a").otherwise("b").alias("category"), F.lit("f").alias("family"), F.lit("key").alias("auth_mode"), F.concat(F.col("r_name"), F.lit("_KEY")).alias("key_var"), F.lit("").alias("base_url"), F.lit("").alias("default_model"), F.col("models"))


@query("SELECT o_orderkey, round(CASE WHEN n_nationkey IS NULL THEN NULL ELSE o_custkey * (n_nationkey + 1.0::DOUBLE) / 1e6 + o_orderkey * (n_nationkey * 2.0::DOUBLE) / 1e6 END, 6) AS cost FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def call_costs(spark, sf_dir):
    """An order is a call of its customer's nation's model."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    u = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("n_name").alias("model"), F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"))
    return catalog.estimate_cost(u, providers(spark, sf_dir)).select("o_orderkey", F.round("cost", 6).alias("cost"))


@query("SELECT r_name AS id, 'unknown' AS auth, false AS clears_key, true AS tiers, true AS streaming, true AS needs_key, CAST(max(n_nationkey) * 1000 AS BIGINT) AS context, bool_or(n_nationkey % 2 = 0) AS vision, bool_or(n_nationkey % 4 = 0) AS tools, bool_or(n_nationkey % 3 = 0) AS reasoning FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def provider_capabilities(spark, sf_dir):
    return catalog.capabilities(providers(spark, sf_dir))
