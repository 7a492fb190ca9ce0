"""URL filters with redirect equivalence, in DataFrame operations only.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest fitting rule wins
(allow at equal length). Pages that redirect to one another or share a canonical link are aliases: connected components
over those edges carry decisions to pages without a rule of their own. An explicit allow anywhere among the aliases
comes before a block; pages whose aliases have no rule at all are allowed.

Targets are resolved against the page's url (relative paths, "..", "?" alone), whatever a tag's length.

Edge cases: a null url or one without "://" has an empty host and path, fits no rule and has no aliases of its own;
repeated pages each get a row; pages with equal urls are one node; an empty page table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

#: Above this many rules, rules are joined by host suffix instead of being tried one by one.
INLINE_RULES = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first "://", or null."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url as a node: lowered host, path and query, without scheme and fragment."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


#: What a browser doesn't read, and the tags that may name another url.
COMMENT, LINK, META = r"(?s)<!--.*?(?:-->|\z)", r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"


def resolved(target: Column, own: Column) -> Column:
    """A link as an absolute url (without scheme where the page's own host is meant), by the page's own url."""
    path = path_of(own)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    name, tail = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    whole = F.when(name == "", path).when(name.startswith("/"), name).otherwise(F.concat(folder, name))
    parts = F.split(whole, "/")
    step = lambda acc, s: F.when(s == "..", F.regexp_replace(acc, r"/[^/]*$", "")).when(s == ".", acc).otherwise(F.concat(acc, F.lit("/"), s))
    clean = F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), step)
    clean = F.when(whole.rlike(r"/\.\.?$"), F.concat(clean, F.lit("/"))).otherwise(clean)
    here = F.when(F.instr(own, "://") > 0, F.concat(F.lit("http://"), host_of(own), F.when(whole == "", "").otherwise(clean), tail))
    return F.when(F.instr(target, "://") > 0, target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).otherwise(here)


def link_targets(html: Column, own: Column) -> Column:
    """Canonical link and redirect targets in a page, as absolute urls. Comments are left out, &amp; is read as &."""
    shown = F.regexp_replace(html, COMMENT, "")
    tags = F.concat(F.regexp_extract_all(shown, F.lit(LINK), 0), F.regexp_extract_all(shown, F.lit(META), 0))
    canonical = F.filter(tags, lambda t: F.regexp_like(t, F.lit(r"""(?i)\brel\s*=\s*["']?canonical\b""")))
    refresh = F.filter(tags, lambda t: F.regexp_like(t, F.lit(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")))
    found = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    found = F.transform(F.filter(found, lambda t: t != ""), lambda t: resolved(F.replace(t, F.lit("&amp;"), F.lit("&")), own))
    return F.filter(found, lambda t: t.isNotNull())


def rule_name(host: str, path: str) -> str:
    return f"{host}/{path.lstrip('/')}"


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """pages with rule and action (null where none fits). rules: (action, host, path that begins with /)."""
    ranked = [(len(rule_name(h, p)), a == "allow", rule_name(h, p), h, p) for a, h, p in rules]
    host, path = F.col(host_col), F.col(path_col)
    if not ranked:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    if len(ranked) <= INLINE_RULES:
        fits = [
            F.when(_fits(host, path, F.lit(h), F.lit(p)), F.struct(F.lit(n).alias("n"), F.lit(ok).alias("ok"), F.lit(name).alias("rule"), F.lit("allow" if ok else "block").alias("action")))
            for n, ok, name, h, p in sorted(ranked)
        ]
        best = F.greatest(*fits) if len(fits) > 1 else fits[0]
        return pages.withColumn("__best", best).withColumns({"rule": F.col("__best.rule"), "action": F.col("__best.action")}).drop("__best")
    # Many rules: one row for each distinct host suffix with its rules' paths, joined on the suffix. Hosts are made
    # distinct first, so a host with a third of all pages is one row here.
    table = pages.sparkSession.createDataFrame([(h, p, n, bool(ok), name) for n, ok, name, h, p in ranked], "rule_host string, rule_path string, n int, ok boolean, rule string")
    by_host = table.groupBy("rule_host").agg(F.collect_list(F.struct("n", "ok", "rule", "rule_path")).alias("own"))
    hosts = pages.select(host.alias("__host")).distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    per_host = hosts.select("__host", F.explode(suffixes).alias("rule_host")).join(by_host, "rule_host").groupBy("__host").agg(F.flatten(F.collect_list("own")).alias("own"))
    joined = pages.join(written(per_host, "rules-by-host"), host == F.col("__host"), "left")  # a plain shuffle: a hot host can be split
    fit = F.array_max(F.filter("own", lambda r: path.startswith(r["rule_path"])))
    return joined.withColumn("__fit", fit).withColumns({"rule": F.col("__fit.rule"), "action": F.when(F.col("__fit.ok"), "allow").when(~F.col("__fit.ok"), "block")}).drop("__fit", "own", "__host")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], edges: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Per page: id, host, path, rule, verdict, node and component (the smallest alias).

    edges: further redirects as (a, b) urls; canonical links and refreshes are read from html_col if it is given.
    """
    url = F.col(url_col).cast("string")
    plain = pages.select(F.col(id_col), url.alias("__url"), *([F.col(html_col).alias("__html")] if html_col else []))
    links = None
    if html_col:
        links = plain.select(node_of(F.col("__url")).alias("a"), F.explode(link_targets(F.col("__html"), F.col("__url"))).alias("t")).select("a", node_of(F.col("t")).alias("b"))
    if edges is not None:
        more = edges.select(node_of(F.col("a").cast("string")).alias("a"), node_of(F.col("b").cast("string")).alias("b"))
        links = more if links is None else links.unionAll(more)
    base = with_rule(plain.select(F.col(id_col), host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), node_of(F.col("__url")).alias("node")), rules)
    if links is None:
        return base.select(id_col, "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), "node", F.col("node").alias("component"))
    comp = connected_components(links, "aliases")
    # What each set of aliases has been told; pages outside any set decide by their own node, so equal urls agree anyway.
    members = base.select("node", "action").where("action is not null").distinct().join(comp, "node")
    told = members.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"))
    inherited = comp.join(told, "component").select("node", "component", F.when(F.col("allowed"), "allow").otherwise("block").alias("by_alias"))
    alone = comp.join(told, "component", "left_anti").select("node", "component", F.lit(None).cast("string").alias("by_alias"))
    # Pages without a node stay out of the join: all of them would meet in one task.
    known = base.where("node is not null").join(inherited.unionAll(alone), "node", "left")
    nowhere = base.where("node is null").withColumns({"component": F.lit(None).cast("string"), "by_alias": F.lit(None).cast("string")})
    out = known.unionByName(nowhere)
    return out.select(id_col, "host", "path", "rule", F.coalesce("action", "by_alias", F.lit("allow")).alias("verdict"), "node", F.coalesce("component", "node").alias("component"))


#: The rules that the op4 query is given: action, host, path.
OP4_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op4(spark, sf_dir: str) -> DataFrame:
    """Per page: host, path, rule and verdict. Null urls and those without "://" have an empty host and path, no rule and are allowed."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), OP4_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail, rest IS NOT NULL AS ok FROM base
), noded AS (SELECT *, CASE WHEN ok THEN host || tail END AS node FROM parsed),
rules(rule, host_r, path_r, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
judged AS (
  SELECT p.page_id, p.host, p.path, p.node, p.html,
         (SELECT max({'n': length(rule), 'rule': rule, 'action': action}) FROM rules WHERE (p.host = host_r OR ends_with(p.host, '.' || host_r)) AND starts_with(p.path, path_r)) AS best
  FROM noded p
), shown AS (SELECT node, host, path, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g') AS html FROM judged),
tags AS (SELECT node, host, path, unnest(list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*>'), regexp_extract_all(html, '(?is)<meta\b[^>]*>'))) AS tag FROM shown),
named AS (
  SELECT node, host, path, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM tags WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
  UNION ALL SELECT node, host, path, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')
), targets AS (SELECT node, host, path, replace(t, '&amp;', '&') AS t, regexp_extract(replace(t, '&amp;', '&'), '^[^?#]*') AS name FROM named WHERE t <> ''),
joined AS (SELECT *, CASE WHEN name = '' THEN path WHEN starts_with(name, '/') THEN name ELSE regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || name END AS long FROM targets),
tidy AS (SELECT *, list_reduce(list_concat([''], string_split(long, '/')[2:]), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END) || CASE WHEN regexp_matches(long, '/\.\.?$') THEN '/' ELSE '' END AS clean FROM joined),
whole AS (SELECT node AS a, CASE WHEN instr(t, '://') > 0 THEN substr(t, instr(t, '://') + 3) WHEN starts_with(t, '//') THEN substr(t, 3) ELSE host || CASE WHEN long = '' THEN '' ELSE clean END || substr(t, length(name) + 1) END AS b FROM tidy),
edges AS (SELECT a, translate(regexp_extract(b, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(b, '^[^/?#]*([^#]*)', 1) AS b FROM whole WHERE a IS NOT NULL AND b IS NOT NULL),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
told AS (SELECT r.a AS node, max(CASE WHEN j.best.action = 'allow' THEN 1 ELSE 0 END) AS allowed FROM reach r JOIN judged j ON j.node = r.b WHERE j.best IS NOT NULL GROUP BY 1)
SELECT j.page_id, j.host, j.path, j.best.rule AS rule, coalesce(j.best.action, CASE WHEN t.allowed = 1 THEN 'allow' WHEN t.allowed = 0 THEN 'block' END, 'allow') AS verdict
FROM judged j LEFT JOIN told t ON j.node = t.node
"""
