"""The queries op1_ to op13_ and pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import table
from textquarry.llm.secret_scan import CLASSES


#: (verdict, host and path prefix)
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.url_rules import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_column_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokens

    from textquarry.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.embed_dedup import link

    return link(table(spark, sf_dir, "embeddings"))


def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.toxicity import classify, default_categories, train

    docs = table(spark, sf_dir, "documents")
    chain = train(docs, table(spark, sf_dir, "labels"), default_categories())
    return classify(docs.select("doc_id", "text"), chain).select("doc_id", "toxicity.p_low_quality", "toxicity.p_toxic", F.col("toxicity.is_toxic").alias("toxic"))


def op6_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.jaccard_join import link

    return link(table(spark, sf_dir, "documents"), width=4, percent=85)


def op7_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.decontam import match

    best = F.try_element_at("matches", F.lit(1))
    return match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"), best["item_id"].alias("item_id"), best["coverage"].alias("coverage"), best["tiles"].alias("tiles")
    )


def op8_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs.filter(fold != 0).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op9_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.secret_scan import joined, scan

    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokens

    from textquarry.llm.token_shards import materialise

    return materialise(table(spark, sf_dir, "documents"), tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken"))


def op11_escaped_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.infill import restore, transform

    size = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return transform(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n", "form", size("prefix"), size("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def op12_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_multinomial_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.mixing import plan, report

    return report(plan(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_redirect_equivalence": op1_redirect_equivalence,
    "op2_column_suffix_dedup": op2_column_suffix_dedup,
    "op3_cost_balanced_packing": op3_cost_balanced_packing,
    "op4_pruned_graph": op4_pruned_graph,
    "op5_classifier_chain": op5_classifier_chain,
    "op6_grouped_prefix_join": op6_grouped_prefix_join,
    "op7_greedy_string_tiling": op7_greedy_string_tiling,
    "op8_script_viterbi": op8_script_viterbi,
    "op9_secret_entropy": op9_secret_entropy,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_escaped_markers": op11_escaped_markers,
    "op12_pivot_collocations": op12_pivot_collocations,
    "op13_multinomial_blocks": op13_multinomial_blocks,
    "pipeline": pipeline,
}

_REACH = """r AS (SELECT id, id AS c FROM ids UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.c)"""

# op1 in SQL: normal forms, and targets of canonical links and refreshes that are absolute and in double quotes (the tables hold
# no others), meet on the level of normal forms.
_HOST = r"translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
_FORM = (
    f"(regexp_replace({_HOST}, ':(80|443)$', '') || regexp_replace({_PATH}, '/+$', '') || coalesce('?' || nullif(array_to_string(list_sort(list_filter("
    r"string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), ''))"
)
_RANKED = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[0] != "allow"))


def _rule_case(value: int) -> str:
    fits = lambda r: f"(h = '{r.partition('/')[0]}' OR h LIKE '%.{r.partition('/')[0]}') AND starts_with(p, '/{r.partition('/')[2]}')"
    return "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[value]}'" for r in _RANKED) + " END"


_URL_SQL = f"""WITH RECURSIVE pages_ AS (SELECT page_id, url, html, coalesce(contains(url, '://'), false) AS ok FROM pages),
links AS (SELECT url, unnest([regexp_extract(html, '<link rel="canonical" href="([^"]*://[^"]*)"', 1), regexp_extract(html, '<meta http-equiv="refresh" content="[0-9]+; ?url=([^"]*://[^"]*)"', 1)]) AS target FROM pages_ WHERE ok),
named AS (SELECT url AS u FROM pages_ WHERE ok UNION SELECT target FROM links WHERE target <> ''),
parts AS (SELECT u, {_HOST.format(u='u')} AS h, {_PATH.format(u='u')} AS p, {_FORM.format(u='u')} AS f FROM named),
ruled AS (SELECT u, f, h, p, {_rule_case(1)} AS rule, {_rule_case(0)} AS said FROM parts),
e AS (SELECT DISTINCT a.f AS x, b.f AS y FROM links l JOIN parts a ON a.u = l.url JOIN parts b ON b.u = l.target),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT f AS id, f AS c FROM parts UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.c),
says AS (SELECT r.id AS f, min(said) AS said, min(u) AS component FROM r JOIN ruled ON ruled.f = r.c GROUP BY r.id)
SELECT page_id, coalesce(h, '') AS host, coalesce(p, '') AS path, rule, coalesce(ruled.said, says.said, 'allow') AS verdict, coalesce(component, url) AS component
FROM pages_ LEFT JOIN ruled ON ruled.u = url LEFT JOIN says ON says.f = ruled.f"""

# op9 in SQL: code-point places by running sums of the pieces between matches; entropy of every window by its definition.
_SQ = lambda x: x.replace("'", "''")
_PLACED = "(SELECT doc_id, hit, part, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS pos FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{p}', 0)) AS hit, unnest(regexp_extract_all(t, '{p}', {g})) AS part, unnest(regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}', 0))]) AS gap, unnest(range(len(regexp_extract_all(t, '{p}', 0)))) AS i FROM t WHERE regexp_matches(t, '{p}')))"
_BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(part) >= 6"),
    ("access", "AKIA[A-Z0-9]+", 0, "length(hit) >= 20"),
    ("hex", "[0-9a-f]+", 0, "length(hit) >= 24"),
]
_NEEDS = lambda c: " AND ".join(f"regexp_matches(hit, '{x}')" for x in c.needs[3:-1].split(")(?="))  # noqa: E731  lookaheads one by one
_WINDOWS = " UNION ALL ".join(
    f"SELECT doc_id, pos, hit, {k} AS nth, {c.bits} AS bits FROM {_PLACED.format(p='[' + ''.join(chr(92) + x if x in '-/+' else x for x in c.alphabet) + ']{20,}', g=0)} WHERE {_NEEDS(c)}" for k, c in enumerate(CLASSES)
)
_SECRET_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({' UNION ALL '.join(f"SELECT doc_id, '{n}' AS kind, {k} AS rank, pos AS a, pos + length(hit) AS z FROM {_PLACED.format(p=_SQ(p), g=g)} WHERE {w}" for k, (n, p, g, w) in enumerate(_BASE))}),
c AS (SELECT * FROM ({_WINDOWS}) WHERE NOT contains(hit, 'EXAMPLE') AND NOT regexp_matches(hit, '(?i:placeholder|changeme|your[_-])') AND NOT regexp_full_match(hit, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')),
w AS (SELECT doc_id, nth, pos, i FROM (SELECT *, unnest(range(length(hit) - 19)) AS i FROM c) WHERE list_aggregate(string_split(substr(hit, i + 1, 20), ''), 'entropy') >= bits - 1e-9),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, nth, pos ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, nth, pos ORDER BY i) <= 20 THEN 0 ELSE 1 END AS fresh FROM w)),
m AS (SELECT doc_id, kind, rank, a, z FROM b UNION SELECT doc_id, 'entropy', 3, pos + min(i), pos + max(i) + 20 FROM g GROUP BY doc_id, nth, pos, run),
f AS (SELECT doc_id, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY a, rank, z) AS spans FROM m GROUP BY doc_id),
h AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS x, count(*) FILTER (kind = 'access') AS y, count(*) FILTER (kind = 'hex') AS k, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY a, rank) AS s FROM b GROUP BY doc_id)
SELECT t.doc_id, coalesce(x, 0) AS n_assign, coalesce(y, 0) AS n_access, coalesce(k, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)"""

# op2 in SQL: every window of 100 bytes as a row, the first of equal ones apart.
_REPEATS_SQL = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, b[i + 1:i + 100] AS s FROM (SELECT *, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM r)),
m AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run), k AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM m),
f AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS head, max(z) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN head IS NULL THEN b ELSE unhex(head || hex(b[last + 1:])) END) AS kept_sha256 FROM d LEFT JOIN f USING (doc_id)"""

# op11 in SQL: the parts by their code points. DuckDB has no hexadecimal literals in texts of its own making, so digits are summed.
_HEX = "CAST(list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(s, CAST({at} + i AS BIGINT), 1)) - 1) * (16 ** (8 - i))::BIGINT)) AS BIGINT)"
_INFILL_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, {_HEX.format(at=0)} % (n + 1) AS x, {_HEX.format(at=8)} % (n + 1) AS y, {_HEX.format(at=16)} % 100 AS u, {_HEX.format(at=24)} % 100 AS v FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
sha256(t) AS restored_sha256 FROM f"""

# op12 in SQL: every phrase as a row.
_PHRASES_SQL = """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS a FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
s AS (SELECT lang, c.k, g, a, i, array_to_string(string_split(g, ' ')[1:i], ' ') AS x, array_to_string(string_split(g, ' ')[i + 1:], ' ') AS y FROM c, (VALUES (1), (2)) v(i) WHERE i < c.k),
b AS (SELECT s.lang, s.k, s.g, s.a, min({'score': (1000000::HUGEINT * s.a * s.a) // (x.a::HUGEINT * y.a), 'i': i, 'l': x.a, 'r': y.a}) AS cut FROM s JOIN f x ON x.lang = s.lang AND x.g = s.x JOIN f y ON y.lang = s.lang AND y.g = s.y GROUP BY ALL),
o AS (SELECT lang, unnest([array_to_string(string_split(g, ' ')[1:2], ' '), array_to_string(string_split(g, ' ')[2:3], ' ')]) AS g, a FROM c WHERE k = 3),
m AS (SELECT lang, g, max(a) AS most FROM o GROUP BY ALL),
u AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g AND b.k = 2 WHERE most IS NULL OR 100 * most < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, encode(g)) AS rank FROM u)
SELECT lang, rank, g AS phrase, a, cut.l AS l, cut.r AS r, CAST(n AS BIGINT) AS n, CAST(cut.score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op12_pivot_collocations": _PHRASES_SQL,
    "op11_escaped_markers": _INFILL_SQL,
    "op1_redirect_equivalence": _URL_SQL,
    "op2_column_suffix_dedup": _REPEATS_SQL,
    "op9_secret_entropy": _SECRET_SQL,
    "op4_pruned_graph": f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.x = id) AS n_links, min(c) AS component_id, min(c) = id AS kept FROM r GROUP BY id""",
    "op6_grouped_prefix_join": f"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)), {_REACH}
SELECT id AS doc_id, coalesce((SELECT n FROM n WHERE n.doc_id = id), 0) AS n_shingles, min(c) AS component_id FROM r GROUP BY id""",
}
