"""Queries of the page rules and their SQL.

The tables hold no HTML, so the signals that pages lack are made from what pages have (length of the URL, inbound
links, family): the same way here and in the SQL, so that every rule meets pages that break it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..operators import graph as G
from ..operators import rules as R
from ..operators.common import ranked, table
from . import graphs as GQ
from .history import _REFS, _refs

_BLOCK = "struct<valid_json:boolean,types:array<string>,ids:array<string>,same_as:array<string>,raw:string,nodes:array<struct<types:array<string>,properties:array<string>>>>"


def site_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of the latest snapshots as the page rules read them, and searches for the town of some of them."""
    last = _refs(s, d).select(F.col("latest").alias("snapshot_id"))
    p = table(s, d, "pages").join(last, "snapshot_id", "left_semi").groupBy("url").agg(*[F.max(c).alias(c) for c in ("status", "indexable", "title", "family", "inbound")])
    town = F.regexp_extract("url", "/services/[^/?]*-([a-z]+)$", 1)
    asked = p.where((town != "") & (F.length("url") % 3 == 0)).select(F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)/", 1), F.lit("/find?city="), town).alias("url"), F.lit(200).alias("status"), F.lit("indexable").alias("indexable"), F.lit("Find").alias("title"), F.lit(None).cast("string").alias("family"), F.lit(3).alias("inbound")).distinct()
    p = ranked(p.unionByName(asked), [F.asc("url")], "ordinal").withColumn("ordinal", F.col("ordinal").cast("long"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    p = p.withColumns({"_l": F.length("url"), "_h": F.length(host), "_b": F.col("inbound") % 11}).withColumns({"_k": F.col("_l") % 7, "_j": F.col("_l") % 5})
    c = lambda *cases, other: _cases(cases, other)
    k, j, b, h, l = (F.col(x) for x in ("_k", "_j", "_b", "_h", "_l"))
    text = F.lit
    none = F.array().cast("array<string>")
    empty = F.lit(None).cast("string")
    alternate = lambda lang, href: F.struct(text(lang).alias("hreflang"), href.alias("href"))
    alternates = "array<struct<hreflang:string,href:string>>"
    heading = lambda level, t: F.struct(F.lit(level).alias("level"), t.alias("text"))
    image = lambda src, alt, hidden: F.struct(text(src).alias("src"), F.lit(alt).cast("string").alias("alt"), F.lit(hidden).alias("hidden"))
    images = "array<struct<src:string,alt:string,hidden:boolean>>"
    block = lambda valid, raw, *nodes: F.array(F.struct(F.lit(valid).alias("valid_json"), F.array(*[text(n[0]) for n in nodes]).cast("array<string>").alias("types"), none.alias("ids"), none.alias("same_as"), text(raw).alias("raw"), F.array(*[F.struct(F.array(text(n[0])).alias("types"), F.array(*map(text, n[1])).cast("array<string>").alias("properties")) for n in nodes]).alias("nodes"))).cast(f"array<{_BLOCK}>")
    header = lambda name, value: F.struct(text(name).alias("k"), value.alias("v"))
    headers = F.filter(F.array(
        header("strict-transport-security", c((h % 4 == 1, text("max-age=0")), ((h % 4 == 2) & (l % 2 == 0), text("max-age=9")), (h % 4 == 3, text("max-age=9")), other=empty)),
        header("x-content-type-options", c((h % 3 != 0, text("nosniff")), other=empty)),
        header("content-security-policy", c((h % 4 == 1, text("default-src 'self'")), (h % 4 == 3, text("frame-ancestors 'none'")), ((h % 4 == 2) & (l % 3 == 0), text("default-src")), other=empty)),
        header("x-frame-options", c((h % 5 == 0, text("DENY")), other=empty)), header("referrer-policy", c((h % 2 == 0, text("origin")), other=empty)),
    ), lambda x: x["v"].isNotNull())
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    hop = lambda a, z, code: F.struct(a.alias("from"), z.alias("to"), F.lit(code).alias("status"))
    return p.select(
        "url", "status", F.when(F.col("url").contains("/press"), "pdf").otherwise("html").alias("media"), "ordinal", "family", "inbound", "title", "indexable",
        c((k == 0, empty), (k == 1, F.concat("url", text("-moved"))), ((k == 2) & F.col("url").rlike("^[a-z]+://[^/]+/.*[^/]+$"), F.regexp_replace("url", "[^/]+$", "")), other=F.col("url")).alias("canonical"),
        F.when(F.col("indexable") == "noindex", F.array(text("noindex, follow"))).otherwise(none).alias("robots"), F.when(k == 3, " ").otherwise(F.col("title")).alias("_title"),
        c((b == 0, empty), (b == 1, text("")), (b == 2, F.concat(text(" About "), F.coalesce("family", text("all")))), other=F.concat(text("About "), F.col("url"))).alias("description"),
        F.when(j == 0, empty).otherwise("en").alias("html_lang"),
        c((F.col("url").contains("/en/"), F.array(alternate("de", F.regexp_replace("url", "/en/", "/de/")), alternate("fr", F.concat("url", text("-gone"))))), (F.col("url").contains("/de/") & (b < 6), F.array(alternate("en", F.regexp_replace("url", "/de/", "/en/")))), other=F.array().cast(alternates)).alias("alternates"),
        c((b == 4, F.array().cast("array<struct<level:int,text:string>>")), (b == 5, F.array(heading(1, text("One")), heading(1, text("Two")))), other=F.array(heading(1, F.coalesce("title", text("h"))), heading(2, text("More on it")))).alias("headings"),
        c((k == 4, F.array(image("http://img.example/a.png", None, False))), (k == 5, F.array(image("https://img.example/b.png", "x", False))), (k == 6, F.array(image("/a.png", None, True))), other=F.array().cast(images)).alias("images"),
        c((j == 1, block(False, "{")), (j == 2, block(True, '{"@type":"Organization"}', ("Organization", ["logo"]))), (j == 3, block(True, '{"@type":"https://schema.org/Product"}', ("https://schema.org/Product", ["Name"]))), ((j == 4) & (b < 5), block(True, '{"@type":"FAQPage"}', ("FAQPage", ["name"]))), ((j == 4) & (l % 2 == 0), block(True, '{"@type":"LocalBusiness"}', ("LocalBusiness", ["name", "address"]))), (j == 4, block(True, '{"@type":"LocalBusiness","areaServed":"x"}', ("LocalBusiness", ["name", "address"]))), other=F.array().cast(f"array<{_BLOCK}>")).alias("json_ld"),
        c((k == 2, F.concat(text("Frequently asked questions about "), F.col("url"))), (k == 3, F.concat(text("Same  text of "), F.coalesce("family", text("all")))), other=F.concat(text("Text of "), F.col("url"))).alias("text"),
        F.when(b == 6, empty).otherwise("t").alias("og_title"), c((b == 7, empty), (b == 8, text("http://img.example/o.png")), other=text("https://img.example/o.png")).alias("og_image"),
        F.map_from_entries(headers).alias("headers"), empty.alias("csp_meta"), (F.col("inbound") * 20_000).alias("body_bytes"), (l * 50).alias("fetch_ms"), (j != 4).alias("has_main"),
        c(((h % 3 == 1) & (k < 4), F.lit(1)), (k == 6, F.lit(2)), other=F.lit(0)).alias("unlabeled_controls"), (l % 3 == 0).alias("in_sitemap"),
        F.when(F.col("status") == 301, F.array(hop(F.col("url"), F.concat(origin, text("/x")), 302), hop(F.concat(origin, text("/x")), F.concat(origin, text("/find?city="), F.regexp_extract("url", "([a-z]+)$", 1)), 301))).otherwise(F.array().cast("array<struct<from:string,to:string,status:int>>")).alias("redirects"),
    ).drop("title").withColumnRenamed("_title", "title")


def _cases(cases: tuple, other: object) -> object:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(other)


def site_edges(s: SparkSession, d: str) -> DataFrame:
    """Links between pages of a host, their place by the number of the fact."""
    e = table(s, d, "fact_edges").where("source_kind = 'url' AND target_kind = 'url' AND source LIKE 'url:%' AND target LIKE 'url:%'").select("edge_id", F.regexp_replace("source", "^url:", "").alias("src"), F.regexp_replace("target", "^url:", "").alias("dst")).distinct()
    host = lambda c: url_parts(F.col(c))["host"]
    place = F.element_at(F.array(*map(F.lit, ["nav", "footer", "contextual", "header"])), (F.col("edge_id") % 4 + 1).cast("int"))
    return e.where(host("src") == host("dst")).select("src", "dst", place.alias("location"))


def _state(s: SparkSession, d: str) -> DataFrame:
    return R.with_state(site_pages(s, d))


def _seeds(p: DataFrame) -> DataFrame:
    return p.where(F.col("url").rlike("^[a-z]+://[^/]+/$")).select(F.col("url").alias("node"))


def page_states(s: SparkSession, d: str) -> DataFrame:
    """Indexability of every page."""
    return _state(s, d).groupBy("indexability", "status").agg(F.count(F.lit(1)).alias("n_pages"))


def page_rules(s: SparkSession, d: str) -> DataFrame:
    """All rules of single pages."""
    return R.page_local(_state(s, d))


def canonical_rules(s: SparkSession, d: str) -> DataFrame:
    """Canonicals to errors, to canonicalised pages, and out of the crawl."""
    return R.canonical_targets(_state(s, d))


def alternate_rules(s: SparkSession, d: str) -> DataFrame:
    """Alternates without a link back, to errors, to unknown pages, and pages without x-default."""
    p = _state(s, d)
    return R.alternates(p).unionByName(R.default_alternates(p))


def locale_rules(s: SparkSession, d: str) -> DataFrame:
    """Locale twins of which some declare no alternates."""
    return R.locale_groups(_state(s, d))


def metadata_rules(s: SparkSession, d: str) -> DataFrame:
    """Titles and descriptions on several pages."""
    return R.repeated_metadata(_state(s, d))


def content_rules(s: SparkSession, d: str) -> DataFrame:
    """Equal texts on several pages."""
    return R.repeated_content(_state(s, d))


def link_rules(s: SparkSession, d: str) -> DataFrame:
    """Links to errors and links that lead nowhere useful."""
    return R.link_targets(_state(s, d), site_edges(s, d))


def depth_rules(s: SparkSession, d: str) -> DataFrame:
    """Orphans and pages far from every home page."""
    p = _state(s, d)
    return R.link_depths(p, _seeds(p), site_edges(s, d), deep=2)


def security_rules(s: SparkSession, d: str) -> DataFrame:
    """Header rules of every host."""
    return R.host_security(_state(s, d))


def control_rules(s: SparkSession, d: str) -> DataFrame:
    """Controls without a label, per host or per page."""
    return R.shared_controls(_state(s, d))


def publisher_rules(s: SparkSession, d: str) -> DataFrame:
    """Hosts whose publisher has no identity."""
    return R.publishers(_state(s, d))


def schema_rules(s: SparkSession, d: str) -> DataFrame:
    """Typed nodes that lack what their type needs."""
    return R.schema_gaps(_state(s, d))


def city_rules(s: SparkSession, d: str) -> DataFrame:
    """Searches for a town beside a page of it, and town pages that redirect to such a search."""
    return R.city_queries(_state(s, d))


def authority_rules(s: SparkSession, d: str) -> DataFrame:
    """Pages of more than median rank that nobody is shown."""
    rank = G.page_rank(site_edges(s, d)).select("node", F.round("rank", 9).alias("rank"))
    shown = table(s, d, "pages").groupBy("url").agg(F.max("gsc_impressions").alias("gsc_impressions"))
    return R.quiet_authorities(_state(s, d), rank, shown.where(F.length("url") % 2 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (page_states, page_rules, canonical_rules, alternate_rules, locale_rules, metadata_rules, content_rules, link_rules, depth_rules, security_rules, control_rules, publisher_rules, schema_rules, city_rules, authority_rules)
}

_SITE = f"""{_REFS}, s0 AS (SELECT url, max(status) AS status, max(indexable) AS indexable, max(title) AS title, max(family) AS family, max(inbound) AS inbound FROM pages WHERE snapshot_id IN (SELECT latest FROM refs) GROUP BY url),
s1 AS (SELECT * FROM s0 UNION ALL SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+)/', 1) || '/find?city=' || regexp_extract(url, '/services/[^/?]*-([a-z]+)$', 1), 200, 'indexable', 'Find', NULL, 3 FROM s0 WHERE regexp_extract(url, '/services/[^/?]*-([a-z]+)$', 1) <> '' AND length(url) % 3 = 0),
s2 AS (SELECT *, row_number() OVER (ORDER BY url) AS ordinal, length(url) AS l, length(url) % 7 AS k, length(url) % 5 AS j, inbound % 11 AS b, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, length(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h,
  coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, contains(url, '/press') AS pdf FROM s1),
s3 AS (SELECT *, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN url || '-moved' WHEN k = 2 AND regexp_matches(url, '^[a-z]+://[^/]+/.*[^/]+$') THEN regexp_replace(url, '[^/]+$', '') ELSE url END AS canonical, indexable = 'noindex' AS noindex, CASE WHEN k = 3 THEN ' ' ELSE title END AS ti,
  CASE WHEN b = 0 THEN NULL WHEN b = 1 THEN '' WHEN b = 2 THEN ' About ' || coalesce(family, 'all') ELSE 'About ' || url END AS de, j <> 0 AS has_lang, CASE WHEN contains(url, '/en/') THEN 2 WHEN contains(url, '/de/') AND b < 6 THEN 1 ELSE 0 END AS n_alt,
  CASE WHEN b = 4 THEN 0 WHEN b = 5 THEN 2 ELSE 1 END AS n_h1, CASE WHEN k = 2 THEN 'Frequently asked questions about ' || url WHEN k = 3 THEN 'Same  text of ' || coalesce(family, 'all') ELSE 'Text of ' || url END AS text,
  CASE WHEN h % 4 = 1 THEN 'max-age=0' WHEN h % 4 = 2 AND l % 2 = 0 THEN 'max-age=9' WHEN h % 4 = 3 THEN 'max-age=9' END AS hsts, h % 3 <> 0 AS nosniff, CASE WHEN h % 4 = 1 THEN 'default-src' WHEN h % 4 = 3 THEN 'frame-ancestors' WHEN h % 4 = 2 AND l % 3 = 0 THEN 'default-src' END AS csp, h % 5 = 0 AS xfo, h % 2 = 0 AS rp,
  CASE WHEN h % 3 = 1 AND k < 4 THEN 1 WHEN k = 6 THEN 2 ELSE 0 END AS bare, l % 3 = 0 AS in_map FROM s2),
ap AS (SELECT *, CASE WHEN status BETWEEN 300 AND 399 THEN 'redirected' WHEN status >= 400 OR status = 0 THEN 'error' WHEN noindex THEN 'noindex' WHEN canonical <> url THEN 'canonicalized' ELSE 'indexable' END AS ix FROM s3),
ok AS (SELECT *, NOT pdf AS htm FROM ap WHERE status = 200 AND ix = 'indexable'),
ed AS (SELECT DISTINCT edge_id, substr(source, 5) AS src, substr(target, 5) AS dst, ['nav', 'footer', 'contextual', 'header'][edge_id % 4 + 1] AS location FROM fact_edges WHERE source_kind = 'url' AND target_kind = 'url' AND source LIKE 'url:%' AND target LIKE 'url:%' AND regexp_extract(source, '^url:[a-z]+://([^/?#:]*)', 1) = regexp_extract(target, '^url:[a-z]+://([^/?#:]*)', 1) AND regexp_extract(source, '^url:[a-z]+://([^/?#:]*)', 1) <> '')"""


def _rule(code: str, severity: str, source: str, cond: str, subject: str = "url", url: str = "url") -> str:
    return f"SELECT 'SE-{code}' AS code, '{code.split('-')[0]}' AS family, '{severity}' AS severity, {url} AS url, {subject} AS subject FROM {source} WHERE {cond}"


_LOCAL = [
    ("CRAWL-001", "error", "ap", "status BETWEEN 400 AND 499"), ("CRAWL-002", "error", "ap", "status >= 500"), ("CRAWL-003", "warn", "ap", "status = 301"), ("CANON-001", "warn", "ok", "htm AND canonical IS NULL"),
    ("SITEMAP-001", "error", "ap", "in_map AND status >= 400"), ("SITEMAP-002", "warn", "ap", "in_map AND ix = 'noindex'"), ("META-001", "error", "ok", "htm AND coalesce(trim(ti), '') = ''"), ("META-003", "info", "ok", "htm AND coalesce(trim(de), '') = ''"),
    ("META-004", "info", "ok", "htm AND b = 6"), ("META-005", "info", "ok", "htm AND b = 7"), ("SCHEMA-001", "warn", "ok", "j = 1"), ("CONTENT-001", "error", "ok", "htm AND n_h1 = 0"), ("CONTENT-002", "warn", "ok", "htm AND n_h1 > 1"),
    ("A11Y-001", "warn", "ok", "htm AND NOT has_lang"), ("A11Y-002", "warn", "ok", "htm AND k = 4"), ("A11Y-004", "warn", "ok", "htm AND j = 4"), ("PERF-001", "warn", "ok", "inbound * 20000 > 524288"), ("PERF-002", "warn", "ok", "l * 50 > 2500"),
    ("SEC-008", "warn", "ok", "htm AND starts_with(url, 'https://') AND (k = 4 OR b = 8)"), ("AI-002", "warn", "ok", "htm AND b NOT IN (4, 5) AND contains(lower(coalesce(title, 'h')), 'faq') AND NOT (j = 4 AND b < 5)"),
]
_SEC = [
    ("SEC-001", "warn", "https AND n_hsts = 0"), ("SEC-007", "warn", "https AND n_hsts > 0 AND n_hsts < n"), ("SEC-006", "warn", "https AND n_hsts = n AND zero"), ("SEC-002", "info", "NOT nosniff"), ("SEC-007", "warn", "n_csp > 0 AND n_csp < n"),
    ("SEC-003", "info", "n_csp = 0"), ("SEC-004", "info", "NOT anc AND n_xfo = 0"), ("SEC-005", "info", "n_rp = 0"),
]
_ALT = "al AS (SELECT url, unnest(CASE n_alt WHEN 2 THEN [regexp_replace(url, '/en/', '/de/', 'g'), url || '-gone'] WHEN 1 THEN [regexp_replace(url, '/de/', '/en/', 'g')] ELSE [] END) AS dst FROM ap), ae AS (SELECT DISTINCT a.url, a.dst, t.status AS ts, EXISTS (SELECT 1 FROM al r WHERE r.url = a.dst AND r.dst = a.url) AS back FROM al a LEFT JOIN ap t ON t.url = a.dst WHERE a.dst <> a.url)"
_ALL = lambda rules: " UNION ALL ".join(_rule(*r) for r in rules)
SQL: dict[str, str] = {
    "page_states": f"WITH {_SITE} SELECT ix AS indexability, status, count(*) AS n_pages FROM ap GROUP BY 1, 2",
    "page_rules": f"WITH {_SITE} {_ALL(_LOCAL)}",
    "canonical_rules": f"WITH {_SITE}, c AS (SELECT p.url, t.url AS t, t.status AS ts, t.canonical AS tc FROM ap p LEFT JOIN ap t ON t.url = p.canonical WHERE p.status = 200 AND p.canonical <> p.url) "
    + _ALL([("CANON-002", "error", "c", "ts >= 400"), ("CANON-003", "warn", "c", "ts < 400 AND tc <> t AND tc <> url"), ("CANON-004", "info", "c", "t IS NULL")]),
    "alternate_rules": f"WITH {_SITE}, {_ALT} "
    + _ALL([("I18N-001", "warn", "ae", "ts < 400 AND NOT back", "dst"), ("I18N-004", "error", "ae", "ts >= 400", "dst"), ("I18N-005", "info", "ae", "ts IS NULL", "dst"), ("I18N-003", "warn", "ok", "htm AND n_alt > 0")]),
    "locale_rules": f"""WITH {_SITE}, sg AS (SELECT host, url, n_alt, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM ok WHERE htm), lo AS (SELECT *, s[1] IN ('en', 'ru', 'he', 'uk', 'ar', 'es', 'de', 'fr', 'pt', 'it', 'pl', 'nl') AS z FROM sg),
      g AS (SELECT host, array_to_string(CASE WHEN z THEN s[2:] ELSE s END, '/') AS rest, min(url) AS url, count(*) AS n, count(DISTINCT CASE WHEN z THEN s[1] ELSE '' END) AS k, bool_or(n_alt = 0) AS bare FROM lo GROUP BY 1, 2) """
    + _ALL([("I18N-002", "warn", "g", "n >= 2 AND k >= 2 AND bare", "'/' || rest")]),
    "metadata_rules": f"WITH {_SITE}, t AS (SELECT ti AS v, min(url) AS url, count(*) AS n FROM ok WHERE htm AND trim(ti) <> '' GROUP BY 1), e AS (SELECT trim(de) AS v, min(url) AS url, count(*) AS n FROM ok WHERE htm AND trim(de) <> '' GROUP BY 1) "
    + _ALL([("META-002", "warn", "t", "n > 1", "v"), ("META-006", "warn", "e", "n > 1", "v")]),
    "content_rules": f"WITH {_SITE}, t AS (SELECT md5(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS v, min(url) AS url, count(*) AS n FROM ok WHERE trim(text) <> '' GROUP BY 1) " + _ALL([("DUP-001", "warn", "t", "n > 1", "v")]),
    "link_rules": f"WITH {_SITE}, t AS (SELECT DISTINCT e.src, e.dst, e.location, p.status, p.ix FROM ed e JOIN ap p ON p.url = e.dst), a AS (SELECT DISTINCT src, dst FROM t WHERE status >= 400), z AS (SELECT DISTINCT src, dst FROM t WHERE location IN ('nav', 'footer') AND (status >= 400 OR ix <> 'indexable')) "
    + _ALL([("LINK-001", "error", "a", "true", "dst", "src"), ("LINK-005", "warn", "z", "true", "dst", "src")]),
    "depth_rules": f"WITH RECURSIVE {_SITE}, b(node, depth) USING KEY (node) AS (SELECT url, 0 FROM ap WHERE regexp_matches(url, '^[a-z]+://[^/]+/$') UNION SELECT e.dst, b.depth + 1 FROM b JOIN ed e ON e.src = b.node LEFT JOIN recurring.b r ON r.node = e.dst WHERE r.node IS NULL), x AS (SELECT ok.*, b.depth FROM ok LEFT JOIN b ON b.node = ok.url) "
    + _ALL([("LINK-002", "warn", "x", "depth IS NULL AND path <> '/'"), ("LINK-003", "info", "x", "depth > 2")]),
    "security_rules": f"""WITH {_SITE}, hg AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n, arg_min(url, ordinal) AS url, count(hsts) AS n_hsts, bool_and(hsts IS NULL OR hsts = 'max-age=0') AS zero, bool_and(nosniff) AS nosniff, count(csp) AS n_csp, bool_or(coalesce(csp, '') = 'frame-ancestors') AS anc, count(*) FILTER (xfo) AS n_xfo, count(*) FILTER (rp) AS n_rp FROM ap WHERE status = 200 AND NOT pdf GROUP BY 1),
      hs AS (SELECT *, starts_with(url, 'https://') AS https FROM hg) """
    + _ALL([(c, s, "hs", w, "host") for c, s, w in _SEC]),
    "control_rules": f"""WITH {_SITE}, hg AS (SELECT host, count(*) AS n, count(*) FILTER (bare > 0) AS b FROM ok GROUP BY 1), sh AS (SELECT o.host, arg_min(o.url, ordinal) AS url FROM ok o JOIN hg USING (host) WHERE bare > 0 AND hg.b >= 3 AND hg.b * 2 >= hg.n GROUP BY 1),
      sg AS (SELECT o.url FROM ok o JOIN hg USING (host) WHERE bare > 0 AND NOT (hg.b >= 3 AND hg.b * 2 >= hg.n)) """
    + _ALL([("A11Y-005", "warn", "sh", "true", "host"), ("A11Y-005", "warn", "sg", "true")]),
    "publisher_rules": f"WITH {_SITE}, g AS (SELECT host, arg_min(url, ordinal) AS url FROM ok WHERE j = 2 GROUP BY 1) " + _ALL([("AI-001", "warn", "g", "true", "host")]),
    "schema_rules": f"WITH {_SITE} " + _ALL([("SCHEMA-003", "info", "ap", "j = 2", "'Organization/Organization: name'"), ("SCHEMA-002", "warn", "ap", "j = 3", "'Product/Product: review OR aggregateRating OR offers'"), ("SCHEMA-004", "info", "ap", "j = 4 AND b < 5", "'FAQPage/FAQ: mainEntity'")]),
    "city_rules": f"""WITH {_SITE}, q AS (SELECT url, host, regexp_extract(url, '\\?city=([^&]*)', 1) AS city FROM ap WHERE status = 200 AND ix <> 'noindex' AND NOT pdf AND contains(url, '?city=')), m AS (SELECT q.url, min(o.url) AS other FROM q JOIN ok o ON o.host = q.host AND NOT contains(o.url, '?') AND regexp_matches(o.path, '(^|[/-])' || q.city || '([/-]|$)') GROUP BY 1),
      r AS (SELECT url, path, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/find?city=' || regexp_extract(url, '([a-z]+)$', 1) AS dst, regexp_extract(url, '([a-z]+)$', 1) AS city, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM ap WHERE status = 301),
      z AS (SELECT * FROM r WHERE contains(path, '/cities/') OR contains(path, '/city/') OR (contains(coalesce(s[len(s)], ''), '-') AND strlen(coalesce(s[len(s)], '')) > 4) OR contains(path, city)) """
    + _ALL([("CANN-002", "warn", "m", "true", "other"), ("CANN-003", "warn", "z", "true", "dst")]),
}
_RANKS = GQ.SQL["page_rank"].removeprefix(f"WITH {GQ._LINKS}, ").removesuffix(" SELECT node, round(rank, 9) AS rank FROM r20")
SQL["authority_rules"] = f"""WITH {_SITE}, e AS (SELECT src, dst FROM ed), {_RANKS}, sho AS (SELECT url, max(gsc_impressions) AS i FROM pages WHERE length(url) % 2 = 0 GROUP BY 1),
  o AS (SELECT ok.url, round(r20.rank, 9) AS rank, row_number() OVER (ORDER BY round(r20.rank, 9), ok.url) AS k, count(*) OVER () AS n, sho.i FROM ok JOIN r20 ON r20.node = ok.url LEFT JOIN sho ON sho.url = ok.url),
  h AS (SELECT url FROM o WHERE coalesce(i, 0) = 0 AND rank > (SELECT rank FROM o WHERE k = n // 2 + 1)) """ + _ALL([("LINK-004", "info", "h", "true")])
