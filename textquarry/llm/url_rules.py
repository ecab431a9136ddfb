"""URL filter: allow and block rules, spread to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import components, save

#: Up to so many rules are one CASE expression; more are joined by host suffix.
INLINE_RULES = 200
#: Normal forms begin with the last code point, so they are told from addresses and sort behind them.
FORM = "\U0010ffff"
#: Not part of a page's markup: comments, and what stands in scripts, styles and text boxes.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea)\b.*?(?:</\1\s*>|\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def normal_form(url: Column) -> Column:
    """The address, behind FORM, that http/https, fragment, tracking parameters and a closing slash do not change; null without `://`."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)="))), "&")
    base = F.concat(F.lit(FORM), F.regexp_replace(host(url), r":(80|443)$", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def resolve(target: Column, base: Column) -> Column:
    """The absolute address of a link `target` (null: none) on the page `base`, as browsers do it: relative to the scheme, host,
    directory or page, dot segments taken out. Null for an empty target, another scheme (mailto:) and a base without `://`."""
    to = F.regexp_replace(target, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    scheme, own = F.regexp_extract(base, r"^[^/?#]*?://", 0), F.regexp_extract(base, r"^[^/?#]*?://[^/?#]*", 0)
    way = F.regexp_extract(base, r"^[^/?#]*?://[^/?#]*([^?#]*)", 1)
    at = F.when(way == "", F.lit("/")).otherwise(way)
    tail = F.regexp_extract(to, r"[?#].*$", 0)
    named = F.regexp_extract(to, r"^[^?#]*", 0)
    steps = F.split(F.when(named.startswith("/"), named).otherwise(F.concat(F.regexp_extract(at, r"^.*/", 0), named)), "/")
    up, here = lambda x: F.lower(F.regexp_replace(x, "(?i)%2e", ".")) == "..", lambda x: F.lower(F.regexp_replace(x, "(?i)%2e", ".")) == "."
    kept = F.aggregate(
        F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(up(x), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(here(x), acc).otherwise(F.array_append(acc, x)),
    )
    last = F.element_at(steps, -1)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((up(last) | here(last)) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    rooted = (
        F.when(to.startswith("//"), F.concat(scheme, F.substring(to, F.lit(3), F.length(to))))
        .when(to.startswith("?"), F.concat(own, at, to))
        .when(to.startswith("#"), F.concat(own, at, F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1), to))
        .otherwise(F.concat(own, joined, tail))
    )
    return F.when(to == "", None).when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (scheme != ""), rooted)


def _attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute `name` of `tag`, in double, single or no quotes, with spaces around `=`; empty without."""
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
    # Possessive throughout: Java then neither backtracks nor recurses, however long a tag is.
    whole = F.regexp_extract(tag, rf"""(?is)^<\w++(?:[\s/]++(?!{name}\s*=)[^\s=>/"']++(?:\s*+=\s*+{value})?+)*+[\s/]++{name}\s*+=\s*+({value})""", 1)
    bare = F.regexp_replace(whole, r"""^["']|["']$""", "")
    for entity, character in (("&(?:quot|#0*34|#[xX]0*22);", '"'), ("&(?:apos|#0*39|#[xX]0*27);", "'"), ("&(?:#0*47|#[xX]0*2[fF]|sol);", "/"), ("&(?:#0*58|#[xX]0*3[aA]|colon);", ":"), ("&(?:amp|#0*38|#[xX]0*26);", "&")):
        bare = F.regexp_replace(bare, entity, character)
    return bare


def _tags(html: Column, tag: str) -> Column:
    """The start tags `tag`. One ends at `>`, and stops being one at a `<`, outside of quoted values; quotes that don't follow `=` or
    are never closed are characters like others. What stopped is matched as well, and left out afterwards, so the search goes on
    behind it: each character is looked at a fixed number of times, whatever the markup is."""
    found = F.regexp_extract_all(html, F.lit(rf"""(?i)<{tag}(?=[\s/])(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^<>=]++|=)*+>?"""), F.lit(0))
    return F.filter(found, lambda t: t.endswith(">"))


def _first(tags: Column, wanted) -> Column:
    return F.get(F.filter(F.transform(tags, wanted), lambda v: v.isNotNull() & (v != "")), F.lit(0))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of a page's first canonical link and meta refresh that name a target, resolved against the page's own
    address, and of its own normal form. Tags in comments, scripts, styles and text boxes don't count, `<base href>` is not followed,
    and of character references those for quotes, slash, colon and ampersand are read. The time is linear in the html, broken or not."""
    url, told = F.col("url"), F.col("html").rlike("(?i)canonical|http-equiv")
    shown = pages.select("url", F.when(told, F.regexp_replace("html", HIDDEN, " ")).alias("html"))
    html = F.col("html")
    link = lambda t: F.when(F.concat(F.lit(" "), _attribute(t, "rel"), F.lit(" ")).rlike(r"(?i)\scanonical\s"), F.trim(_attribute(t, "href")))
    meta = lambda t: F.when(F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh", _refresh(_attribute(t, "content")))
    canonical = resolve(_first(_tags(html, "link"), link), url)
    refresh = resolve(_first(_tags(html, "meta"), meta), url)
    found = shown.select(url, canonical.alias("canonical"), refresh.alias("refresh"))
    to = F.array_compact(F.array(normal_form(F.col("url")), normal_form(F.col("canonical")), normal_form(F.col("refresh")), F.col("canonical"), F.col("refresh")))
    return found.select(F.col("url").alias("src"), F.explode(to).alias("dst")).filter("src <> dst").distinct()


def _refresh(content: Column) -> Column:
    """The target in `5; url='/page'`; empty where a refresh names none."""
    return F.regexp_replace(F.regexp_extract(content, r"(?is)^\s*[\d.]*\s*[;,\s]\s*url\s*=\s*(.*)$", 1), r"""^["']([^"']*).*$|\s+$""", "$1")


def explicit_rule(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add rule and rule_verdict (null where none fits) to rows with host and path. `rules`: (verdict, "host/path prefix").

    A rule fits its host and all subdomains where the path starts with its own; the longest wins, allow before block
    among equals.
    """
    ranked = sorted({(r, v) for v, r in rules}, key=lambda x: (-len(x[0]), x[1] != "allow", x[0]))
    if len(ranked) <= INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r, v in reversed(ranked):
            name, _, rest = r.partition("/")
            fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
            rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
        return df.withColumns({"rule": rule, "rule_verdict": verdict})
    known = df.sparkSession.createDataFrame(
        [(r.partition("/")[0], "/" + r.partition("/")[2], r, v, i) for i, (r, v) in enumerate(ranked)], "rule_host string, rule_path string, rule string, rule_verdict string, nth int"
    )
    labels = F.split("host", r"\.")
    each = df.select("host", "path").distinct()
    suffixes = each.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    best = (
        suffixes.join(known, "rule_host").filter(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.min_by(F.struct("rule", "rule_verdict"), "nth").alias("b"))
    ).select("host", "path", "b.rule", "b.rule_verdict")
    return df.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: list[tuple[str, str]], edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Judge every row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, component.

    A page that a rule fits has that rule's verdict. Any other takes what its aliases say: connected components over
    link_edges() and `edges` (src, dst: known redirects); a component with an allowed member is allowed, else one with
    a blocked member is blocked, else `default`. Null or malformed urls have no aliases and the default. A url that
    repeats has the same verdict in each of its rows; components are combined before each shuffle, so one large
    component or host is not gathered anywhere. component is the smallest url of the component.
    """
    own = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    links = link_edges(own)
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst"))
    of = save(components(links), "aliases")
    ruled = explicit_rule(own.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
    urls = ruled.filter("url is not null").select("url", "host", "path", "rule_verdict").distinct()
    # Aliases that are not among the pages have a say as well if a rule fits them.
    named = explicit_rule(of.filter(~F.col("node").startswith(FORM)).select(F.col("node").alias("url"), host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), rules)
    said = named.unionByName(urls.select("url", "host", "path", "rule_verdict"), allowMissingColumns=True).filter("rule_verdict is not null").select("url", "rule_verdict").distinct()
    spread = (
        of.join(said, of.node == said.url).groupBy("component").agg(F.min("rule_verdict").alias("spread"))  # allow sorts before block
    )
    alias = of.join(spread, "component", "left").select(F.col("node").alias("url"), "component", "spread")
    return ruled.join(alias, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "spread", F.lit(default)).alias("verdict"), F.coalesce("component", "url").alias("component")
    )


__all__ = ["explicit_rule", "host", "judge", "link_edges", "normal_form", "path"]
