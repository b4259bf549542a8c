"""URL rules with redirect equivalence.

A rule is (host, path, verdict) and fits its host and all subdomains where
the url's path starts with the rule's path; the longest fitting rule (host
and path together) decides. Urls are aliases when a redirect or canonical
link joins them: connected components over canonical <link> tags, <meta>
refresh targets and the url's own canonical form (scheme, fragment, tracking
parameters and trailing slashes dropped) carry every blocked url's decision
to its aliases; a url that is only the end of a link, and no page, blocks its
aliases too. An explicit allow has precedence: a url with an allow rule of
its own stays allowed, however its aliases are judged. A url without a rule
and without a blocked alias is allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-
cased; path: from there up to ``?``, ``#`` or the end; both empty for null
urls and urls without ``://``, which no rule fits. A null url has no alias;
null html has no link. Repeated urls are one node. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, hub

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
LINK = r"(?is)<link\s[^>]*>"
META = r"(?is)<meta\s[^>]*>"
CANONICAL = r"(?is)\srel\s*=\s*[\"']?canonical\b"
REFRESH = r"(?is)\shttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)"


def host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path(url):
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def canonical_form(url):
    """The key of a url; urls without ``://`` are their own."""
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, QUERY, 1), TRACKING, ""), "^&", "")
    key = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), key).otherwise(url)


def resolve(link, url):
    """Absolute url of a link found on the page ``url``."""
    return (F.when(link.contains("://"), link)
            .when(link.startswith("//"), F.concat(F.lit("http:"), link))
            .when(link.startswith("/"), F.concat(F.lit("http://"), host(url), link))
            .otherwise(F.concat(F.lit("http://"), host(url), F.regexp_extract(path(url), r"^(.*/)?", 0), link)))


def link_urls(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): urls joined by a canonical link or a refresh redirect."""
    p = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).filter(
        F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = [F.transform(F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(kind)), lambda t: F.regexp_extract(t, attr, 1))
            for tag, kind, attr in ((LINK, CANONICAL, HREF), (META, REFRESH, TARGET))]
    links = p.select("url", F.explode(F.concat(*tags)).alias("to")).filter("to <> ''")
    return links.select(F.col("url").alias("u"), resolve(F.col("to"), F.col("url")).alias("v"))


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of ``urls`` with the longest fitting rule:
    (host, path, rule, rule_verdict), rows without a rule left out."""
    hp = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    if r.count() <= BROADCAST_ROWS:
        r = F.broadcast(r)
    fits = (hp.filter("host <> ''").select("host", "path", F.explode(suffix).alias("rule_host")).join(r, "rule_host")
            .filter(F.col("path").startswith(F.col("rule_path"))))
    rule = F.concat("rule_host", "rule_path")
    # Of equal rules with different verdicts, allow has precedence ("allow" < "block").
    best = F.max_by(F.struct(rule.alias("rule"), "rule_verdict"), F.struct(F.length(rule), (F.col("rule_verdict") == "allow")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.rule_verdict")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, path, rule, rule_verdict, alias, verdict) of every
    page. ``alias`` names the url's class. ``edges`` (u, v urls) adds redirects
    known from elsewhere, such as a crawl log."""
    url = F.col(url_col)
    named = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"), canonical_form(url).alias("key"))
    named = hub(named)
    links = link_urls(pages, url_col, html_col)
    if edges is not None:
        links = links.union(edges.select("u", "v").filter("u is not null and v is not null"))
    links = hub(links.distinct())
    # Both ends of a link, also those that are no page, have a rule of their own.
    ends = hub(links.select(F.col("u").alias("url")).union(links.select("v")).distinct()
               .select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical_form(F.col("url")).alias("key")))
    fits = hub(matching_rules(named.select("host", "path").union(ends.select("host", "path")), rules))
    comp = components(links.select(canonical_form(F.col("u")).alias("u"), canonical_form(F.col("v")).alias("v"))).withColumnRenamed("node", "key")

    def classed(urls):
        return urls.join(fits, ["host", "path"], "left").join(comp, "key", "left").withColumn("alias", F.coalesce("comp", "key"))
    ruled = hub(classed(named))
    blocked = (ruled.select("rule_verdict", "alias").union(classed(ends).select("rule_verdict", "alias"))
               .filter("rule_verdict = 'block' and alias is not null").select("alias").distinct()
               .withColumn("alias_blocked", F.lit(True)))
    return (ruled.join(blocked, "alias", "left")
            .withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), "block"), F.lit("allow")))
            .select("page_id", "url", "host", "path", "rule", "rule_verdict", "alias", "verdict"))


_KEY = r"""CASE WHEN contains({u}, '://') THEN translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || regexp_replace(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '/+$', '')
  || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END ELSE {u} END"""
_Q = r"regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '')"


def _key(u: str) -> str:
    return _KEY.format(u=u, q=_Q.format(u=u))


ORACLE = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(html, '') AS html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, {_key('url')} AS k FROM pages),
r AS (SELECT p.*, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
links AS (
  SELECT k, host, path, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\s[^>]*>'), lambda t: regexp_matches(t, '(?is)\srel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\s[^>]*>'), lambda t: regexp_matches(t, '(?is)\shttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1)))) AS h
  FROM p WHERE url IS NOT NULL),
targets AS (SELECT k, CASE WHEN contains(h, '://') THEN h WHEN starts_with(h, '//') THEN 'http:' || h WHEN starts_with(h, '/') THEN 'http://' || host || h
  ELSE 'http://' || host || regexp_extract(path, '^(.*/)?') || h END AS t FROM links WHERE h <> ''),
e AS (SELECT k AS a, {_key('t')} AS b FROM targets UNION SELECT {_key('t')}, k FROM targets),
bad AS (SELECT k FROM r WHERE rule IN ('net/', 'example.com/de/') AND k IS NOT NULL UNION SELECT e.b FROM bad JOIN e ON bad.k = e.a)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN k IN (SELECT k FROM bad WHERE k IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
