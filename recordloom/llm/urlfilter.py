"""URL block and allow rules over classes of equivalent URLs.

URLs that differ in spelling only share a canonical form; redirects, meta
refreshes and rel=canonical links join canonical forms, and the connected
components of those edges are classes of aliases.  A rule that matches any alias
decides for its whole class, and an allow rule wins over block rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import connected_components, save, sieve

TRACKING = "utm_[a-z]+|ref|fbclid|gclid|msclkid"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def canonical(url: F.Column) -> F.Column:
    """host/path?query in one spelling; null for a null, blank or hostless URL.

    Scheme, fragment, default ports, a leading www, m or amp, index pages, the
    extension .html, slashes at the end and tracking parameters don't count, nor
    does the order of parameters.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    bare = F.regexp_replace(bare, "^//", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), r"^(www|m|amp)\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(/index)?\.html?$", ""), "/+$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(bare, r"\?(.*)$", 1)), f"&({TRACKING})=[^&]*", "")
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(host != "", F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise("")))


def absolute(link: F.Column, base: F.Column) -> F.Column:
    """link as seen from the page base; null for an empty link."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]*)*/)", 1))
    folder = F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.isNull() | (link == ""), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | link.startswith("//"), link)
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target) canonical forms joined by the first rel=canonical link and the first meta refresh of a page."""
    url, html = F.col(url_col), F.col(html_col)
    link = F.regexp_extract(F.regexp_extract(html, _CANONICAL, 0), _HREF, 1)
    turn = F.regexp_extract(F.regexp_extract(html, _REFRESH, 0), _TARGET, 1)
    found = pages.select(canonical(url).alias("source"), F.explode(F.array(absolute(link, url), absolute(turn, url))).alias("to"))
    return found.select("source", canonical(F.col("to")).alias("target")).where("source is not null and target is not null and source <> target")


def _reach(form: str, labels: int, segments: int) -> F.Column:
    """The rules of at most `labels` labels and `segments` segments that can match a canonical form: each such suffix of its host, alone and with each such prefix of its path."""
    return F.expr(
        f"""transform(array(struct(
            split(substring_index(substring_index({form}, '/', 1), '?', 1), '[.]') as host,
            split(substring_index({form}, '?', 1), '/', {segments + 2}) as path)),
          x -> flatten(transform(sequence(greatest(1, size(x.host) - {labels - 1}), size(x.host)),
            k -> transform(sequence(1, least(size(x.path), {segments + 1})),
              j -> if(j = 1, array_join(slice(x.host, k, size(x.host)), '.'), concat(array_join(slice(x.host, k, size(x.host)), '.'), '/', array_join(slice(x.path, 2, j - 1), '/')))))))[0]"""
    )


def decide(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, alias_class, decision) of every page; decision is allow, block or none.

    rules has columns rule (a host or a host with the beginning of a path, whole
    segments; it covers subdomains) and action (allow or block); other actions
    don't count.  redirects, if given, has columns source and target.  A class
    is named by its alphabetically first canonical form.  Where both kinds of
    rules match a class, it is allowed.

    A page whose URL is null or has no host has a null class and the decision
    none; a null html has no links; pages that share a URL or repeat each have
    their row; rules and redirects with nulls don't count; of a very long URL
    only as many segments are looked up as the longest rule has.  Other columns are
    ignored whatever their names.  An empty table gives an empty result.
    """
    own = save(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), canonical(F.col(url_col)).alias("form")), "urls")
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(canonical(F.col("source")).alias("source"), canonical(F.col("target")).alias("target"))
        edges = edges.unionByName(more.where("source is not null and target is not null and source <> target"))
    edges = save(edges.distinct(), "links")
    forms = own.select("form").where("form is not null").union(edges.select("source")).union(edges.select("target")).distinct()
    forms = save(forms.withColumn("node", F.monotonically_increasing_id()), "forms")
    ends = edges.join(forms.select(F.col("form").alias("source"), F.col("node").alias("u")), "source").join(forms.select(F.col("form").alias("target"), F.col("node").alias("v")), "target")
    parts = connected_components(ends.select("u", "v"))
    forms = forms.join(parts, "node", "left").select("form", F.coalesce("component", "node").alias("component"))
    clean = rules.select(canonical(F.col("rule")).alias("rule"), F.lower("action").alias("action")).where("rule is not null and action in ('allow', 'block')").distinct()
    clean = save(clean, "rules")
    host, path = F.split(F.substring_index("rule", "/", 1), "[.]"), F.split("rule", "/")
    longest = clean.agg(F.max(F.size(host)), F.max(F.size(path) - 1)).first()
    # what no rule says is dropped before the shuffle, so that a suffix which most hosts share is no hot key
    may = sieve(clean.select(F.xxhash64("rule").alias("key")))
    reached = forms.select("component", F.explode(_reach("form", longest[0] or 1, longest[1] or 0)).alias("rule")).where(may(F.xxhash64("rule")))
    hits = reached.distinct().join(clean, "rule").groupBy("component").agg(F.min("action").alias("decision"))
    names = forms.groupBy("component").agg(F.min("form").alias("alias_class"))
    classes = forms.join(names, "component").join(hits, "component", "left").select("form", "alias_class", F.coalesce("decision", F.lit("none")).alias("decision"))
    return own.join(classes, "form", "left").select("page_id", "url", "alias_class", F.coalesce("decision", F.lit("none")).alias("decision"))


#: Policy of the registered query: rule and action.
POLICY = (("example.org", "block"), ("tionsh.example.net/de", "block"), ("blog.ththth.example.org", "allow"), ("ththsh.example.org/en", "allow"))


def oracle(policy: tuple[tuple[str, str], ...] = POLICY) -> str:
    """decide() over the pages table with a policy in canonical spelling, as DuckDB SQL."""

    def form(x: str) -> str:
        bare = f"regexp_replace(regexp_replace(regexp_replace(trim({x}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//', '')"
        host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m|amp)\\.', '')"
        path = f"regexp_replace(regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '(/index)?\\.html?$', ''), '/+$', '')"
        query = f"regexp_replace('&' || regexp_extract({bare}, '\\?(.*)$', 1), '&({TRACKING})=[^&]*', '', 'g')"
        params = f"array_to_string(list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '')), '&')"
        return f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN {params} <> '' THEN '?' || {params} ELSE '' END END"

    def link(tag: str, attribute: str) -> str:
        raw = f"regexp_extract(regexp_extract(html, '{tag.replace(chr(39), chr(39) * 2)}', 0), '{attribute.replace(chr(39), chr(39) * 2)}', 1)"
        root = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
        folder = f"({root} || CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]*)*/)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]*)*/)', 1) END)"
        return f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN NULL WHEN regexp_matches({raw}, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN {raw} WHEN {raw} LIKE '/%' THEN {root} || {raw} ELSE {folder} || {raw} END"

    rules = ", ".join(f"('{r}', '{a}')" for r, a in policy)
    return f"""
WITH RECURSIVE own AS (SELECT page_id, url, {form("url")} AS form FROM pages),
links AS (SELECT {form("url")} AS source, unnest([{link(_CANONICAL, _HREF)}, {link(_REFRESH, _TARGET)}]) AS t FROM pages),
edges AS (SELECT source, {form("t")} AS target FROM links WHERE t IS NOT NULL),
both_ways AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target
  UNION SELECT target, source FROM edges WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target),
forms AS (SELECT form FROM own WHERE form IS NOT NULL UNION SELECT a FROM both_ways),
reach AS (SELECT form AS a, form AS b FROM forms UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
rules(rule, action) AS (VALUES {rules}),
matched AS (
  SELECT f.form, r.action FROM forms f JOIN rules r
  ON ('.' || string_split(string_split(f.form, '/')[1], '?')[1]) LIKE '%.' || string_split(r.rule, '/')[1]
  AND (substr(string_split(f.form, '?')[1], length(string_split(string_split(f.form, '/')[1], '?')[1]) + 1) || '/') LIKE substr(r.rule, length(string_split(r.rule, '/')[1]) + 1) || '/%'
),
decided AS (
  SELECT r.a AS form, min(r.b) AS alias_class, coalesce(min(m.action), 'none') AS decision FROM reach r LEFT JOIN matched m ON m.form = r.b GROUP BY r.a
)
SELECT page_id, url, alias_class, coalesce(decision, 'none') AS decision FROM own LEFT JOIN decided USING (form)
"""
