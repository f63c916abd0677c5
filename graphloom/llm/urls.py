"""URL filters with redirect equivalence, with DataFrame operations alone.

A rule names a host and a path; it fits that host and its subdomains where the path starts with the rule's, and the
longest rule that fits decides. Pages also declare what they are aliases of, by canonical links and by redirects.
Connected components over those links make classes of one resource, and a page without a rule of its own takes the
verdict of its class: allow if a member has an explicit allow, else block if a member is blocked, else allow.

Components are found by stars (see common.components): minima are taken map-side and hubs are left to AQE, so a
target of a third of all pages is no hot task. The classes are broadcast only if they have been counted and are few.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; links
without a target are ignored; pages that share a url share a class; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, pick, share, sized_join, small

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
TARGET = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(part(url, 2), UPPER, LOWER)


def path(url: Column) -> Column:
    return part(url, 3)


def rule(host_: Column, path_: Column, rules: tuple = RULES) -> Column:
    """A struct of the longest rule that fits and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node(url: Column) -> Column:
    """What names a resource: host, path and query, without the scheme and the fragment; null for no url."""
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), path(url), part(url, 4)))


def absolute(target: Column, base: Column) -> Column:
    """A link's target as seen from a page."""
    scheme, top = part(base, 1), F.concat(part(base, 1), F.lit("://"), part(base, 2))
    return (
        F.when(F.coalesce(target, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(top, target))
        .otherwise(F.concat(top, F.regexp_extract(F.concat(path(base), F.when(path(base) == "", "/").otherwise("")), r"(?s)^(.*/)", 1), target))
    )


def links(pages: DataFrame) -> DataFrame:
    """(a, b): resources that a canonical link or a redirect makes equivalent."""
    marked = pages.where(F.col("html").rlike("(?i)canonical|refresh"))
    canonical = F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1)
    redirect = F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1)
    targets = marked.select("url", F.explode(F.array(canonical, redirect)).alias("target"))
    return targets.select(node(F.col("url")).alias("a"), node(absolute(F.col("target"), F.col("url"))).alias("b")).where("a <> b")


def classes(edges: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(node, component, class_allows, class_blocks) of the resources that have links."""
    found = share(components(edges), "classes")
    url = F.concat(F.lit("x://"), F.col("node"))
    judged = found.withColumn("_verdict", rule(host(url), path(url), rules)["verdict"])
    verdicts = judged.groupBy("component").agg(F.coalesce(F.bool_or(F.col("_verdict") == "allow"), F.lit(False)).alias("class_allows"), F.coalesce(F.bool_or(F.col("_verdict") == "block"), F.lit(False)).alias("class_blocks"))
    table, fits = small(verdicts, "class_verdicts")
    return sized_join(found, table, ["component"], "inner", fits)


def filter_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, url, host, path, rule, component, verdict, reason) of each page; component is null without links."""
    rows = pick(pages, "page_id", "url", "html")
    table, fits = small(classes(share(links(rows), "links"), rules), "url_classes")
    url = F.col("url")
    rows = rows.select("page_id", "url", host(url).alias("host"), path(url).alias("path"), node(url).alias("node"))
    rows = rows.withColumn("_own", rule(F.col("host"), F.col("path"), rules))
    joined = sized_join(rows, table, ["node"], "left", fits)
    verdict = F.coalesce(F.col("_own.verdict"), F.when(F.coalesce("class_allows", F.lit(False)), "allow").when(F.coalesce("class_blocks", F.lit(False)), "block").otherwise("allow"))
    reason = F.when(F.col("_own").isNotNull(), "rule").when(F.coalesce(F.col("class_allows") | F.col("class_blocks"), F.lit(False)), "class").otherwise("default")
    return joined.select("page_id", "url", "host", "path", F.col("_own.rule").alias("rule"), "component", verdict.alias("verdict"), reason.alias("reason"))


#: The same in DuckDB's SQL; classes come from a recursive closure of the links.
ORACLE = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1) ELSE '' END AS query
  FROM pages
), targets AS (
  SELECT host || path || query AS a, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)]) AS target
  FROM parts WHERE contains(url, '://')
), links AS (
  SELECT a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(target, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b
  FROM targets WHERE contains(target, '://')
), edges AS (
  SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (
  SELECT a AS node, b AS other FROM edges
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
), ruled AS (
  SELECT node, other, regexp_extract(other, '^([^/?#]*)', 1) AS host, regexp_extract(other, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM reach
), class_verdicts AS (
  SELECT node, bool_or(rule IN ('com/', 'www.example.com/en/')) AS allows, bool_or(rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AS blocks
  FROM (SELECT node, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM ruled)
  GROUP BY node
), judged AS (
  SELECT page_id, host, path, host || path || query AS node, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
)
SELECT j.page_id, j.host, j.path, j.rule,
  CASE WHEN j.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN j.rule IS NOT NULL THEN 'block'
    WHEN coalesce(c.allows, false) THEN 'allow' WHEN coalesce(c.blocks, false) THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN class_verdicts c ON j.node = c.node
"""
