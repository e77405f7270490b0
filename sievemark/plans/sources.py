"""Queries over routes, policies, seeds, robots, the evidence graph and its chains, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_public_host, url_parts
from ..operators import binding as B
from ..operators import discovery as DI
from ..operators import routes as RO
from ..operators import rules as R
from ..operators.common import table
from ..sources import robots as RB
from ..sources.html import extract
from ..sources.policy import Policy, allows
from .history import _REFS, _refs
from .site import _SITE, site_edges, site_pages

POLICY = Policy(include=("/:locale/services/**", "/:locale/blog/*", "/:locale/:page"), exclude=("/**/products",))
ROBOTS = "User-agent: *\nDisallow: /private\nDisallow: /*?item=\nAllow: /private/open$\n\nUser-agent: {agent}\nDisallow: /\nAllow: /services/"


def _state(s: SparkSession, d: str) -> DataFrame:
    return R.with_state(site_pages(s, d))


# ---- routes
def _families(s: SparkSession, d: str) -> DataFrame:
    """Families of the producers' paths; a third of them is left out, so that some pages have none."""
    p = table(s, d, "pages").where("producer_key IS NOT NULL").select(F.col("producer_key").alias("path"), F.lit("").alias("source")).distinct()
    return RO.route_families(p.where(F.length("path") % 3 > 0)).withColumn("has_static_params", F.length("owner") % 2 == 0)


def route_patterns(s: SparkSession, d: str) -> DataFrame:
    """Route of every producer path."""
    p = table(s, d, "pages").where("producer_key IS NOT NULL").select("producer_key").distinct()
    return p.select("producer_key", RO.app_pattern(F.col("producer_key")).alias("pattern"))


def route_matches(s: SparkSession, d: str) -> DataFrame:
    """Pages per predicted route."""
    met = RO.match_routes(_state(s, d).select(F.col("_path").alias("path")), _families(s, d))
    return met.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_paths"))


def route_rules(s: SparkSession, d: str) -> DataFrame:
    """Routes without a page, pages without a route, routes of many pages, and a missing sitemap module."""
    return RO.route_findings(_state(s, d), _families(s, d), lambda c: allows(c, POLICY), has_sitemap=False)


def policy_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths that the policy, and the guess without one, let be indexed."""
    p = _state(s, d).select(F.col("_path").alias("path")).distinct()
    return p.select("path", allows(F.col("path"), POLICY).alias("by_policy"), allows(F.col("path"), None).alias("by_guess"))


def faq_rules(s: SparkSession, d: str) -> DataFrame:
    """Families with a faq producer that no page belongs to."""
    rows = [("FaqList", "app/faq-list.tsx", "/:locale/nothing/:here"), ("FaqList", "app/faq-list.tsx", "/:locale/faq"), ("faqSchema", "app/faq.tsx", "/other/:x"), ("Faq", "app/b.tsx", "/:locale/none")]
    return RO.faq_findings(_state(s, d), s.createDataFrame(rows, "name string, path string, pattern string"))


# ---- discovery
def seed_urls(s: SparkSession, d: str) -> DataFrame:
    """Seeds of every host from observations and snapshots, each with its strongest source."""
    return DI.directed_seeds(table(s, d, "observations"), table(s, d, "pages"))


def frontier_lanes(s: SparkSession, d: str) -> DataFrame:
    """Lane and place of every URL that waits to be fetched."""
    seeds = DI.directed_seeds(table(s, d, "observations"), table(s, d, "pages"))
    return DI.frontier(seeds, s.createDataFrame([("services",), ("blog",)], "landing string")).select("host", "lane", "place", "url")


def public_hosts(s: SparkSession, d: str) -> DataFrame:
    """Hosts of all kinds, and whether a crawler may ask them."""
    real = table(s, d, "pages").select(url_parts(F.col("url"))["host"].alias("host"))
    some = s.createDataFrame([(h,) for h in ("10.1.2.3", "127.0.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "169.254.1.1", "100.64.0.1", "8.8.8.8", "localhost", "metadata.google.internal", "a.internal", "::1", "fe80::1", "fd00::2", "2001:db8::1")], "host string")
    return real.unionByName(some).distinct().select("host", is_public_host(F.col("host")).alias("is_public"))


def agent_rules(s: SparkSession, d: str) -> DataFrame:
    """Listed crawlers that sites keep out, and sites without llms.txt; every site names one crawler by its length."""
    sites = table(s, d, "runs").where("site IS NOT NULL").select(F.regexp_replace("site", "/+$", "").alias("origin")).distinct()
    agents = table(s, d, "ai_agents").select("token", "provider", "role")
    named = sites.join(agents.select("token").where("length(token) % 4 = 1"), F.length("origin") % 7 == F.length("token") % 7, "left").groupBy("origin").agg(F.min("token").alias("agent"))
    files = named.select("origin", F.replace(F.lit(ROBOTS), F.lit("{agent}"), F.coalesce("agent", F.lit("nobody"))).alias("body"))
    probes = sites.select("origin", F.when(F.length("origin") % 2 == 0, 404).otherwise(200).alias("llms_status"))
    return R.agent_access(RB.agent_matrix(files, agents), probes)


def robots_paths(s: SparkSession, d: str) -> DataFrame:
    """Pages that a general rule file shuts out for a crawler that it doesn't name."""
    p = table(s, d, "pages").select(url_parts(F.col("url")).alias("p")).select("p.host", F.concat(F.col("p.path"), F.coalesce(F.concat(F.lit("?"), F.col("p.query")), F.lit(""))).alias("path")).distinct()
    files = p.select(F.col("host").alias("origin")).distinct().withColumn("body", F.replace(F.lit(ROBOTS), F.lit("{agent}"), F.lit("somebot")))
    asked = p.select(F.col("host").alias("origin"), F.lit("otherbot").alias("agent"), "path")
    return RB.allowed(asked, RB.robots_rules(files)).groupBy("origin").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_blocked"))


# ---- files of a site
def sitemap_locations(s: SparkSession, d: str) -> DataFrame:
    """Locations of sitemap files, one file per page, with entities and CDATA."""
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    p = table(s, d, "pages").where("url IS NOT NULL").select("url").distinct()
    loc = F.when(F.length("url") % 2 == 0, F.concat(F.lit(" "), escaped, F.lit("\n"))).otherwise(F.concat(F.lit("<![CDATA["), escaped, F.lit("]]>")))
    return RB.sitemap_urls(p.select(F.concat(F.when(F.length("url") % 3 == 0, "<sitemapindex><sitemap><loc>").otherwise("<urlset><url><loc>"), loc, F.lit("</loc></url>")).alias("body")))


def page_extraction(s: SparkSession, d: str) -> DataFrame:
    """What extraction finds in pages written as HTML."""
    p = site_pages(s, d).select("url", F.coalesce("title", F.lit("")).alias("t"), F.coalesce("family", F.lit("")).alias("f"), "inbound")
    odd = F.length("url") % 2 == 0
    html = F.concat(
        F.lit('<html lang="'), F.when(odd, "de").otherwise("en"), F.lit('"><head><title> '), F.col("t"), F.lit("</title><meta name=robots content=noindex><link rel=canonical href='"), F.col("url"), F.lit("'></head><body><nav><a href=/n>N</a></nav><main><h1>"), F.col("t"),
        F.lit("</h1><p><b>Some words<br>of "), F.col("f"), F.lit("</p><script>var x = \"</p>\";</script><a href='"), F.col("url"), F.lit("'>here</a>"), F.when(odd, "<h2>More</h2><img src=a alt=''><input>").otherwise("<img src=b>"), F.lit("</main></body></html>"),
    )
    e = p.select("url", extract(html).alias("e"))
    return e.select("url", "e.title", "e.html_lang", "e.canonical", F.array_join("e.robots", ",").alias("robots"), F.size("e.headings").alias("n_headings"), F.size("e.links").alias("n_links"), F.col("e.links")[1]["location"].alias("location"), F.col("e.images")[0]["alt"].alias("alt"), "e.has_main", "e.unlabeled_controls", F.col("e.text").startswith("Some words of").alias("has_text"))


# ---- evidence graph
def page_relations(s: SparkSession, d: str) -> DataFrame:
    """Edges of the pages by relation."""
    return B.page_edges(_state(s, d), site_edges(s, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))


def bound_graph(s: SparkSession, d: str) -> DataFrame:
    """Nodes by kind and facts by relation of the graph that pages, routes and chunks make."""
    p = _state(s, d)
    routes = _families(s, d)
    nodes, facts = B.bind(p, routes=routes, matches=RO.match_routes(p.select(F.col("_path").alias("path")), routes))
    return nodes.groupBy(F.concat(F.lit("node:"), F.col("kind")).alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(facts.groupBy(F.concat(F.lit("fact:"), F.col("relation")).alias("what")).agg(F.count(F.lit(1)).alias("n")))


def linked_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages by whether another one links to them."""
    return B.mark_inbound(_state(s, d), B.page_edges(_state(s, d), site_edges(s, d))).groupBy("_linked").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("inbound_links").alias("n_links")).withColumnRenamed("_linked", "linked")


def explain_chains(s: SparkSession, d: str) -> DataFrame:
    """What stands behind every page with a finding in a latest snapshot."""
    last = _refs(s, d).select(F.col("latest").alias("snapshot_id"))
    subjects = table(s, d, "findings").join(last, "snapshot_id", "left_semi").where("url IS NOT NULL").select(F.col("url").alias("subject")).distinct()
    facts = table(s, d, "fact_edges").where("source <> '' AND target <> ''")
    return B.explain(subjects, facts, table(s, d, "search_nodes").where("id IS NOT NULL").select("id", "kind"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (route_patterns, route_matches, route_rules, policy_paths, faq_rules, seed_urls, frontier_lanes, public_hosts, agent_rules, robots_paths, sitemap_locations, page_extraction, page_relations, bound_graph, linked_pages, explain_chains)
}

_PATTERN = "CASE WHEN regexp_matches({0}, '^(.*/)?app/(.*/)?/?page\\.(tsx|ts|jsx|js|mdx)$') THEN '/' || array_to_string(list_transform(list_filter(string_split(regexp_extract({0}, '^(?:.*?/)?app/(.*?)/?page\\.[a-z]+$', 1), '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^\\[\\.\\.\\.(.*)\\]$', '*\\1'), '^\\[(.*)\\]$', ':\\1')), '/') END"
_ROUTES = f"""{_SITE}, fam AS (SELECT pattern, min(path) AS owner FROM (SELECT path, {_PATTERN.format('path')} AS pattern FROM (SELECT DISTINCT producer_key AS path FROM pages WHERE producer_key IS NOT NULL AND length(producer_key) % 3 > 0)) WHERE pattern IS NOT NULL GROUP BY 1),
rx AS (SELECT *, '^' || coalesce(nullif(regexp_replace(rtrim(pattern, '/'), '/:[^/]+', '/[^/]+', 'g'), ''), '') || '/?$' AS re FROM fam), pa AS (SELECT DISTINCT path FROM ap), mt AS (SELECT path, pattern FROM pa JOIN rx ON regexp_matches(path, re))"""
_ALLOW = "(regexp_matches({0}, '^(/[^/]+)?/services(/[^/]+)*/?$') OR regexp_matches({0}, '^(/[^/]+)?/blog/[^/]+/?$') OR regexp_matches({0}, '^(/[^/]+)?/[^/]+/?$')) AND NOT regexp_matches({0}, '^(/[^/]+)*/products/?$')"
_SEEDS = """so AS (SELECT url, CASE WHEN kind = 'search_performance' THEN 5 WHEN kind = 'bot_crawl' THEN 4 ELSE 3 END AS r FROM observations WHERE kind IN ('search_performance', 'bot_crawl', 'ai_citation', 'ai_referral', 'ai_prompt') AND url IS NOT NULL UNION ALL SELECT url, 2 FROM pages),
sd AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, ['', 'previous_snapshot', 'ai_citation', 'log', 'gsc'][max(r)] AS source FROM so WHERE regexp_matches(url, '^https?://[^/?#]+') GROUP BY 1)"""
SQL: dict[str, str] = {
    "route_patterns": f"SELECT producer_key, {_PATTERN.format('producer_key')} AS pattern FROM (SELECT DISTINCT producer_key FROM pages WHERE producer_key IS NOT NULL)",
    "route_matches": f"WITH {_ROUTES} SELECT pattern, count(*) AS n_paths FROM mt GROUP BY 1",
    "route_rules": f"""WITH {_ROUTES} SELECT 'SE-RENDER-001' AS code, 'RENDER' AS family, 'info' AS severity, owner AS url, pattern AS subject FROM fam WHERE {_ALLOW.format('pattern')} AND pattern NOT IN (SELECT pattern FROM mt)
      UNION ALL SELECT 'SE-RENDER-002', 'RENDER', 'info', url, url FROM ap WHERE status = 200 AND {_ALLOW.format('path')} AND path NOT IN (SELECT path FROM mt) UNION ALL SELECT 'SE-PROG-001', 'PROG', CASE WHEN length(owner) % 2 = 0 THEN 'info' ELSE 'warn' END, owner, pattern FROM fam WHERE contains(pattern, ':city') OR contains(pattern, '*') UNION ALL SELECT 'SE-SITEMAP-003', 'SITEMAP', 'warn', '', 'sitemap.ts'""",
    "policy_paths": f"WITH {_SITE} SELECT DISTINCT path, {_ALLOW.format('path')} AS by_policy, NOT (" + " OR ".join(f"contains(path, '{t}')" for t in ["/*", "/admin", "/dashboard", "/auth", "/chats", "/settings", "/pro/", "/tasks/", "/profile"]) + ") AS by_guess FROM ap",
    "faq_rules": f"WITH {_SITE}, l AS (SELECT 'app/faq-list.tsx' AS path, '/:locale/nothing/:here' AS pattern UNION ALL SELECT 'app/faq-list.tsx', '/:locale/faq' UNION ALL SELECT 'app/b.tsx', '/:locale/none') SELECT 'SE-AI-003' AS code, 'AI' AS family, 'warn' AS severity, l.path AS url, pattern AS subject FROM l WHERE NOT EXISTS (SELECT 1 FROM ok WHERE htm AND (regexp_matches(ok.path, '^' || regexp_replace(l.pattern, '/:[^/]+', '/[^/]+', 'g') || '/?$') OR regexp_matches(ok.path, '^' || regexp_replace(regexp_replace(l.pattern, '^/:locale', ''), '/:[^/]+', '/[^/]+', 'g') || '/?$')))",
    "seed_urls": f"WITH {_SEEDS} SELECT host, url, source FROM sd",
    "frontier_lanes": f"""WITH {_SEEDS}, p AS (SELECT *, coalesce(nullif(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM sd), g AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p),
      f AS (SELECT *, CASE WHEN s[1] IN ('en', 'ru', 'he', 'es', 'fr', 'de') THEN s[2:] ELSE s END AS r FROM g), c AS (SELECT *, CASE WHEN len(r) = 3 AND r[1] IN ('category', 'services') AND contains(r[3], '-') THEN 'category/' || r[2] END AS fam FROM f),
      n AS (SELECT *, CASE WHEN fam IS NOT NULL THEN row_number() OVER (PARTITION BY host, fam ORDER BY url) END AS k FROM c), l AS (SELECT *, CASE WHEN k <= 2 OR r[1] IN ('services', 'blog') AND len(r) = 1 OR source IN ('gsc', 'log', 'ai_citation') THEN 'urgent' ELSE 'linked' END AS lane FROM n)
      SELECT host, lane, row_number() OVER (PARTITION BY host, lane ORDER BY CASE source WHEN 'gsc' THEN 5 WHEN 'log' THEN 4 WHEN 'ai_citation' THEN 3 ELSE 2 END DESC, url) AS place, url FROM l""",
    "public_hosts": "SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, true AS is_public FROM pages UNION ALL SELECT unnest(['10.1.2.3', '127.0.0.1', '172.16.0.1', '192.168.1.1', '169.254.1.1', '100.64.0.1', 'localhost', 'metadata.google.internal', 'a.internal', '::1', 'fe80::1', 'fd00::2']), false UNION ALL SELECT unnest(['172.32.0.1', '8.8.8.8', '2001:db8::1']), true",
    "agent_rules": """WITH st AS (SELECT DISTINCT regexp_replace(site, '/+$', '') AS origin FROM runs WHERE site IS NOT NULL), n AS (SELECT origin, min(token) AS agent FROM st LEFT JOIN ai_agents ON length(token) % 4 = 1 AND length(origin) % 7 = length(token) % 7 GROUP BY 1)
      SELECT 'SE-AI-004' AS code, 'AI' AS family, 'info' AS severity, origin AS url, origin AS subject FROM st WHERE length(origin) % 2 = 0 UNION ALL SELECT 'SE-AI-005', 'AI', CASE WHEN role = 'search_discovery' THEN 'warn' ELSE 'info' END, origin, token FROM n JOIN ai_agents ON starts_with(lower(token), n.agent)""",
    "robots_paths": "WITH p AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS origin, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), ''), '/') AS path FROM pages) SELECT origin, count(*) FILTER (NOT contains(path, '?item=') AND NOT starts_with(path, '/private')) AS n_allowed, count(*) FILTER (contains(path, '?item=') OR starts_with(path, '/private')) AS n_blocked FROM p GROUP BY 1",
    "sitemap_locations": "SELECT DISTINCT CASE WHEN length(url) % 3 = 0 THEN 'sitemap' ELSE 'url' END AS kind, url AS loc FROM pages WHERE url IS NOT NULL",
    "page_extraction": f"WITH {_SITE}, p AS (SELECT url, regexp_replace(trim(coalesce(ti, '')), '\\s+', ' ', 'g') AS t, length(url) % 2 = 0 AS odd FROM ap) SELECT url, t AS title, CASE WHEN odd THEN 'de' ELSE 'en' END AS html_lang, url AS canonical, 'noindex' AS robots, CASE WHEN odd THEN 2 ELSE 1 END AS n_headings, 2 AS n_links, 'contextual' AS location, CASE WHEN odd THEN '' END AS alt, true AS has_main, CASE WHEN odd THEN 1 ELSE 0 END AS unlabeled_controls, true AS has_text FROM p",
    "page_relations": f"""WITH {_SITE}, r AS (SELECT url AS src, canonical AS dst, 'canonical_to' AS relation FROM ap WHERE canonical <> url UNION ALL SELECT * FROM (SELECT url AS src, unnest(CASE n_alt WHEN 2 THEN [regexp_replace(url, '/en/', '/de/', 'g'), url || '-gone'] WHEN 1 THEN [regexp_replace(url, '/de/', '/en/', 'g')] ELSE [] END) AS dst, 'alternate_of' FROM ap) WHERE src <> dst
      UNION ALL SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/x', 'redirects_to' FROM ap WHERE status = 301 UNION ALL SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/find?city=' || regexp_extract(url, '([a-z]+)$', 1), 'redirects_to' FROM ap WHERE status = 301
      UNION ALL SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/sitemap.xml', 'listed_in_sitemap' FROM ap WHERE in_map UNION ALL SELECT src, dst, 'links_to' FROM ed) SELECT relation, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM r GROUP BY 1""",
    "bound_graph": f"""WITH {_ROUTES} SELECT 'node:url' AS what, count(*) AS n FROM ap UNION ALL SELECT 'node:schema_object', count(*) FROM ap WHERE j >= 2 UNION ALL SELECT 'node:route_family', count(*) FROM fam UNION ALL SELECT 'node:source_symbol', count(DISTINCT owner) FROM fam
      UNION ALL SELECT 'fact:declares', count(*) FROM ap WHERE j >= 2 UNION ALL SELECT 'fact:generated_by', count(*) FROM fam UNION ALL SELECT 'fact:rendered_by', count(*) FROM ap JOIN mt USING (path)""",
    "linked_pages": f"WITH {_SITE}, n AS (SELECT dst, count(*) AS n FROM ed GROUP BY 1) SELECT coalesce(n, 0) > 0 OR path = '/' AS linked, count(*) AS n_pages, sum(coalesce(n, 0))::BIGINT AS n_links FROM ap LEFT JOIN n ON n.dst = ap.url GROUP BY 1",
    "explain_chains": f"""WITH {_REFS}, s AS (SELECT DISTINCT url AS subject FROM findings WHERE url IS NOT NULL AND snapshot_id IN (SELECT latest FROM refs)), f AS (SELECT DISTINCT source, target, relation FROM fact_edges WHERE source <> '' AND target <> ''),
      h0 AS (SELECT subject, 0 AS hop, '' AS relation, 'url:' || subject AS node FROM s), h1 AS (SELECT DISTINCT subject, 1 AS hop, f.relation, f.target AS node FROM h0 JOIN f ON f.source = node WHERE f.relation IN ('rendered_by', 'claims', 'about', 'compared_against', 'changed_by')),
      nx(a, b) AS (VALUES ('rendered_by', 'metadata_from'), ('rendered_by', 'generated_by'), ('claims', 'governed_by'), ('claims', 'requires'), ('requires', 'defined_at')),
      h2 AS (SELECT DISTINCT subject, 2 AS hop, f.relation, f.target AS node FROM h1 JOIN f ON f.source = node JOIN nx ON a = h1.relation AND b = f.relation), h3 AS (SELECT DISTINCT subject, 3 AS hop, f.relation, f.target AS node FROM h2 JOIN f ON f.source = node JOIN nx ON a = h2.relation AND b = f.relation),
      u AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3), b AS (SELECT subject, node, min((hop, relation)) AS m FROM u GROUP BY 1, 2), k AS (SELECT id, min(kind) AS kind FROM search_nodes WHERE id IS NOT NULL GROUP BY 1)
      SELECT subject, m[1] AS hop, m[2] AS relation, node, coalesce(kind, string_split(node, ':')[1]) AS kind FROM b LEFT JOIN k ON k.id = node""",
}
