"""Queries over markets, claims, rendered pages, town families and other sites, and their SQL.

They read the pages of site.site_pages(); town pages are service pages whose last word, a town, is a folder of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..operators import claims as CL
from ..operators import competitors as K
from ..operators import content as C
from ..operators import matrices as M
from ..operators import observations as O
from ..operators import planning as P
from ..operators import render as RE
from ..operators import rules as R
from ..operators.common import table
from ..operators.snapshots import consecutive_snapshots, snapshot_changes
from .evidence import _AZ, _CTR, _CUR, _FACTS
from .preparation import _CHANGES
from .site import _SITE, _rule, site_edges, site_pages

_SLUG = "/services/([^/?]*)-([a-z]+)$"
PACKS = [
    CL.Pack("north", "de", ("kestrel",), (("kestrelford", "Kestrelford"), ("Lower-Ambry", "Lower Ambry"), ("text", "Text")), (CL.Claim("hedge", ("Hedge - care", "hedge-trim"), "hedge_verified"),), (("hedge_verified", ("hedge_verified:false", "hedge_verified=false")),)),
    CL.Pack("south", "fr", ("tarn",), (("tarnhaven", "Tarnhaven"),), (CL.Claim("tile", ("tile-laying",), "tile_verified"),), (("tile_verified", ("tile_verified=false",)),)),
    CL.Pack("east", "test", ("ambry",), (("castel-noro", "Castel Noro"), ("merrow-bay", "Merrow Bay"), ("text", "Text"))),
]
SIGNALS = CL.Signals(hosts=(("test", ".test"),), paths=(("de", "/de/"), ("fr", "/fr/")), texts=(("de", "kayak"),))
FILES = [("src/kestrel.ts", "const a = 1\nexport const x = { hedge_verified: false }\n// tarnhaven"), ("src/tarn.ts", "tile_verified = true"), ("src/plain.ts", "let hedge_verified = false"), ("doc/kestrel.md", "castel-noro")]


def _state(s: SparkSession, d: str) -> DataFrame:
    return R.with_state(site_pages(s, d))


def _towns(s: SparkSession, d: str) -> DataFrame:
    place = lambda c: F.regexp_replace(c, _SLUG, "/services/$1/$2")
    p = site_pages(s, d)
    return R.with_state(p.withColumns({"url": place("url"), "canonical": place("canonical")})).withColumn("_linked", F.col("inbound") > 0)


def _files(s: SparkSession) -> DataFrame:
    return s.createDataFrame(FILES, "path string, source string")


# ---- markets and claims
def market_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages per market."""
    return CL.with_market(_state(s, d), SIGNALS).groupBy(F.coalesce("_market", F.lit("unknown")).alias("market")).agg(F.count(F.lit(1)).alias("n_pages"))


def market_rules(s: SparkSession, d: str) -> DataFrame:
    """Pages and sources that name entities of another market."""
    return CL.market_findings(_state(s, d), PACKS, SIGNALS).unionByName(CL.source_entities(_files(s), PACKS))


def claim_rules(s: SparkSession, d: str) -> DataFrame:
    """Claims of pages that the sources of their market contradict."""
    return CL.claim_findings(CL.page_claims(_state(s, d), PACKS, SIGNALS), CL.false_facts(_files(s), PACKS))


def claim_facts(s: SparkSession, d: str) -> DataFrame:
    """Facts that sources say are false."""
    return CL.false_facts(_files(s), PACKS)


def entity_rules(s: SparkSession, d: str) -> DataFrame:
    """Entities of the own market that JSON-LD doesn't declare, per host or per page."""
    return CL.entity_findings(_state(s, d), PACKS, SIGNALS)


def town_rules(s: SparkSession, d: str) -> DataFrame:
    """Service pages without a type of place, or with one that has no geography."""
    return CL.town_findings(_state(s, d), F.col("_path").contains("/services/"))


# ---- rendered pages
def rendered_pages(p: DataFrame) -> DataFrame:
    """What a browser would have seen, made from the pages."""
    l, b = F.length("url"), F.col("inbound") % 11
    k, j = l % 7, l % 5
    first = F.try_element_at("headings", F.lit(1))["text"]
    return p.select(
        F.when(b == 3, F.concat("url", F.lit("#r"))).when(b == 6, F.regexp_replace("url", "^[a-z]+://[^/]+", "https://copy.example")).when(k == 6, F.concat("url", F.lit("/gone"))).otherwise(F.col("url")).alias("url"),
        F.when(k == 5, "other").when(k == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), F.trim("title"))).alias("title"), F.when(b == 2, F.col("url")).when(b == 4, "x").otherwise(F.lit(None).cast("string")).alias("canonical"),
        F.when(j == 1, "Other").otherwise(F.coalesce(first, F.lit("h"))).alias("h1"), F.when(j == 0, F.array(F.lit("WebPage"))).otherwise(F.array().cast("array<string>")).alias("json_ld_types"),
    )


def render_rules(s: SparkSession, d: str) -> DataFrame:
    """What differs between the page as sent and as rendered."""
    p = site_pages(s, d)
    return RE.reconcile(R.with_state(p), rendered_pages(p)).distinct()


def render_states(s: SparkSession, d: str) -> DataFrame:
    """Rendered pages per state."""
    p = site_pages(s, d)
    return RE.layer_states(R.with_state(p), rendered_pages(p)).groupBy("state").agg(F.count(F.lit(1)).alias("n_urls"))


# ---- town families
def _shares(s: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    f = M.town_family(F.col("_path"))
    return C.family_shares((_towns(s, d) if p is None else p).where("_ok").withColumn("_f", f), F.col("_f.family"), F.col("_f.town"), "_url")


def family_shares(s: SparkSession, d: str) -> DataFrame:
    """What town families share, substitute and say for themselves."""
    return _shares(s, d)


def family_rules(s: SparkSession, d: str) -> DataFrame:
    """Families that share nearly everything, and towns that say the same."""
    p = _towns(s, d)
    return C.template_families(_shares(s, d, p)).unionByName(M.thin_towns(p))


def _matrices(s: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    predicted = s.createDataFrame([("/:locale/category/:city",), ("/about",)], "pattern string")
    return M.compile_matrices(_towns(s, d) if p is None else p, site_edges(s, d), predicted)


def matrix_compiled(s: SparkSession, d: str) -> DataFrame:
    """Matrix, verdict and unmet gates of every town family."""
    return _matrices(s, d).withColumn("unmet", F.array_join(M.unmet(F.col("gates")), ", ")).drop("gates")


def matrix_enriched(s: SparkSession, d: str) -> DataFrame:
    """The same with what content measures, demand and claims add."""
    towns = _towns(s, d)
    m = M.enrich(_matrices(s, d, towns), _shares(s, d, towns))
    p = table(s, d, "pages").withColumn("_f", M.town_family(url_parts(F.regexp_replace("url", _SLUG, "/services/$1/$2"))["path"])).where("_f IS NOT NULL")
    demand = p.groupBy(F.col("_f.family").alias("family")).agg(F.sum("gsc_clicks").alias("gsc_clicks"), F.sum("gsc_impressions").alias("gsc_impressions"))
    claims = claim_rules(s, d).withColumn("subject_family", M.town_family(url_parts(F.regexp_replace("url", _SLUG, "/services/$1/$2"))["path"])["family"])
    return M.annotate(m, demand, claims).select("family", "verdict", "fact_coverage", "unique_fact_ratio", "boilerplate_ratio", "semantic_distinctness", "doorway_risk", "schema_fact_coverage", "demand_coverage", "claim_integrity", "gsc_clicks", "gsc_impressions", F.array_join(M.unmet(F.col("gates")), ", ").alias("unmet"))


# ---- other sites
def site_shapes(s: SparkSession, d: str) -> DataFrame:
    """Traits of every site."""
    return K.shapes(_state(s, d))


def competitor_gaps(s: SparkSession, d: str) -> DataFrame:
    """What other sites have that the first one by name lacks."""
    p = _state(s, d)
    owned = p.agg(F.min("_host")).first()[0] or ""
    edges = site_edges(s, d).withColumn("site", url_parts(F.col("src"))["host"])
    return K.gaps(K.shapes(p), K.totals(p, edges), owned)


# ---- opportunities
def _items(s: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    p = _towns(s, d) if p is None else p
    orphans = R.link_depths(p, p.where(F.col("_path") == "/").select(F.col("_url").alias("node")), _town_edges(s, d)).where("code = 'SE-LINK-002'")
    m = _matrices(s, d, p)
    return P.base_opportunities(p, orphans, m)


def _town_edges(s: SparkSession, d: str) -> DataFrame:
    place = lambda c: F.regexp_replace(c, _SLUG, "/services/$1/$2")
    return site_edges(s, d).withColumns({"src": place("src"), "dst": place("dst")})


def _decorated(s: SparkSession, d: str, p: DataFrame) -> DataFrame:
    # provider rows name the plain URLs of service pages
    rows = O.current_rows(table(s, d, "observations"), "difficulty", "serp_features").withColumn("url", F.regexp_replace("url", _SLUG, "/services/$1/$2"))
    pages = p.select(F.col("_url").alias("page_url"), "inbound", (F.col("inbound") / 100).alias("rank"))
    return P.decorate(_items(s, d, p), rows, O.demand_axes(rows), pages)


def opportunity_axes(s: SparkSession, d: str) -> DataFrame:
    """Opportunities with what search and the market show of them."""
    return _decorated(s, d, _towns(s, d)).drop("summary")


def _made(s: SparkSession, d: str) -> DataFrame:
    """Families that sources produce: those of pages whose producer's hash begins with a digit."""
    p = table(s, d, "pages").where(F.col("producer_hash").rlike("^[0-9]")).select(M.town_family(url_parts(F.regexp_replace("url", _SLUG, "/services/$1/$2"))["path"])["family"].alias("family"), F.col("producer_key").alias("path"), F.col("producer_hash").alias("hash"))
    return p.where("family IS NOT NULL").distinct()


def _with_family(items: DataFrame) -> DataFrame:
    return items.withColumn("family", F.coalesce(M.town_family(url_parts(F.col("subject"))["path"])["family"], F.col("subject")))


def opportunity_build(s: SparkSession, d: str) -> DataFrame:
    """How hard each opportunity is to build."""
    p = _towns(s, d)
    return P.difficulty_to_build(_with_family(_decorated(s, d, p)), _shares(s, d, p), _made(s, d)).select("kind", "subject", "difficulty_to_build")


def _handoff(s: SparkSession, d: str) -> DataFrame:
    actions = _with_family(P.plan_stages(_items(s, d)).select("subject", "action").distinct())
    return P.handoff(actions, _made(s, d))


def plan_handoff(s: SparkSession, d: str) -> DataFrame:
    """Sources that the plan's actions change."""
    return _handoff(s, d)


def plan_stale(s: SparkSession, d: str) -> DataFrame:
    """Sources of the plan that newer ones no longer match."""
    return P.stale_targets(_handoff(s, d), _made(s, d).where(F.length("path") % 3 > 0).withColumn("hash", F.when(F.length("path") % 2 == 0, "0").otherwise(F.col("hash"))))


def plan_waits(s: SparkSession, d: str) -> DataFrame:
    """Links that wait for the creation of their page."""
    items = _items(s, d)
    created = items.where((F.col("kind") == "content_gap") & (F.length("subject") % 2 == 0)).withColumn("kind", F.lit("create_family"))
    return P.plan_links(P.plan_stages(items.unionByName(created)))


def producer_changes(s: SparkSession, d: str) -> DataFrame:
    """Producers that came, went or changed between consecutive snapshots of a site."""
    p = table(s, d, "pages").select("snapshot_id", "producer_key", "producer_hash")
    pairs = consecutive_snapshots(table(s, d, "runs"), p)
    return snapshot_changes(p, pairs, "producer_key", F.col("producer_hash"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (market_pages, market_rules, claim_rules, claim_facts, entity_rules, town_rules, render_rules, render_states, family_shares, family_rules, matrix_compiled, matrix_enriched, site_shapes, competitor_gaps, opportunity_axes, opportunity_build, plan_handoff, plan_stale, plan_waits, producer_changes)
}

_MARKET = f"""{_SITE}, mk AS (SELECT *, CASE WHEN host LIKE '%.test' THEN 'test' WHEN contains(path, '/de/') THEN 'de' WHEN contains(path, '/fr/') THEN 'fr' WHEN contains(lower(text), 'kayak') THEN 'de' END AS market FROM ap)"""


def _named(token: str) -> str:
    return f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){token}([^A-Za-z0-9]|$)')"


def _label_list(pairs: list[tuple[str, str]]) -> str:
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {_named(t)} THEN '{label}' END" for t, label in pairs) + "], lambda x: x IS NOT NULL)))"


def _by_market(own: bool) -> str:
    pick = lambda p: [e for o in PACKS if (o.id == p.id) == own for e in o.entities]
    return "CASE market " + " ".join(f"WHEN '{p.market}' THEN {_label_list(pick(p))}" for p in PACKS) + " END"


_TOWNS = f"""{_SITE}, tw AS (SELECT *, regexp_replace(url, '{_SLUG}', '/services/\\1/\\2') AS turl, list_filter(string_split(regexp_replace(path, '{_SLUG}', '/services/\\1/\\2'), '/'), lambda x: x <> '') AS sg FROM ap),
tr AS (SELECT *, CASE WHEN sg[1] IN ('en', 'ru', 'he', 'es', 'fr', 'de') THEN sg[2:] ELSE sg END AS r FROM tw),
tf AS (SELECT *, 'category/' || r[2] AS fam, r[3] AS town, inbound > 0 AS linked, list_distinct(list_filter(string_split_regex({_AZ.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2)) AS toks, list_filter(string_split(coalesce(r[3], ''), '-'), lambda x: strlen(x) >= 2) AS ct
  FROM tr WHERE r[1] IN ('category', 'services') AND (len(r) = 2 OR (len(r) = 3 AND (contains(r[3], '-') OR strlen(r[3]) >= 4)))),
ff AS (SELECT * FROM tf WHERE status = 200 AND ix = 'indexable'),
hd AS (SELECT fam, count(*) AS n, sum(len(toks)) AS total, count(*) FILTER (len(list_filter(toks, lambda t: (regexp_matches(t, '[0-9]') OR t IN ({_FACTS})) AND NOT list_contains(ct, t))) > 0) AS loc, count(*) FILTER (j <> 0) AS sch, min(turl) AS first_page FROM ff GROUP BY 1),
tk AS (SELECT fam, t, count(*) AS c, sum(p) AS p FROM (SELECT fam, unnest(toks) AS t, unnest(list_transform(toks, lambda t: list_contains(ct, t)::INT)) AS p FROM ff) GROUP BY 1, 2),
sh AS (SELECT fam AS family, n AS measured_urls, least(100, sum(CASE WHEN c = n THEN c ELSE 0 END) * 100 // total)::INT AS template_shared_ratio, least(100, sum(CASE WHEN c < n THEN p ELSE 0 END) * 100 // total)::INT AS parameter_substitution_ratio,
  least(100, sum(CASE WHEN c < n AND (regexp_matches(t, '[0-9]') OR t IN ({_FACTS})) THEN c - p ELSE 0 END) * 100 // total)::INT AS unique_fact_ratio, least(100, sum(CASE WHEN c < n AND NOT (regexp_matches(t, '[0-9]') OR t IN ({_FACTS})) THEN c - p ELSE 0 END) * 100 // total)::INT AS unique_semantic_ratio,
  (loc * 100 // n)::INT AS local_fact_coverage, (sch * 100 // n)::INT AS schema_fact_coverage, first_page FROM tk JOIN hd USING (fam) GROUP BY fam, n, total, loc, sch, first_page),
th AS (SELECT fam, min(turl) AS url, count(*) AS n FROM (SELECT fam, turl, array_to_string(list_filter(string_split_regex(replace(lower(text), town, ' '), '\\s+'), lambda x: x <> ''), ' ') AS bare FROM ff WHERE town IS NOT NULL AND town NOT IN ('prices', 'reviews', 'about', 'new', 'edit', 'index', 'all')) GROUP BY fam, bare HAVING count(*) > 1)"""
_HEAD = "CASE WHEN b = 4 THEN '' WHEN b = 5 THEN 'One Two' ELSE coalesce(title, 'h') || ' More on it' END"
_COMPILED = f"""{_TOWNS}, mq AS (SELECT fam AS family, count(*) AS n, count(*) FILTER (ix = 'indexable') AS i, count(DISTINCT CASE WHEN ix = 'indexable' THEN array_to_string(list_filter(string_split_regex({_HEAD} || ' ' || text, '\\s+'), lambda x: x <> ''), ' ') END) AS u, count(*) FILTER (ix = 'indexable' AND canonical <> '') AS c,
  bool_and(in_map AND NOT linked) AS only_map, min(turl) AS first_page, count(DISTINCT CASE WHEN town NOT IN ('prices', 'reviews', 'about', 'new', 'edit', 'index', 'all') THEN town END) AS card FROM tf WHERE status = 200 GROUP BY 1),
cm AS (SELECT family, n AS measured_urls, i AS n_indexable, u AS n_unique, nullif(card, 0) AS estimated_cardinality, CASE WHEN card > 0 THEN least(100, n * 100 // card) END::INT AS measured_sample_rate, CASE WHEN i > 0 THEN (c * 100 // i)::INT END AS canonical_coverage, CASE WHEN only_map THEN 0 ELSE 100 END AS internal_discovery, (100 - u * 100 // n)::INT AS cannibalization_risk,
  CASE WHEN u >= 2 THEN (u * 100 // n)::INT END AS semantic_distinctness, CASE WHEN i = 0 THEN 'NOINDEX_BY_DEFAULT' WHEN i >= 2 AND u = 1 THEN 'CONSOLIDATE' WHEN u >= 2 AND NOT only_map THEN 'SAFE_IF_REQUIREMENTS_MET' WHEN only_map THEN 'REVIEW' WHEN u = 1 THEN 'SAFE_IF_REQUIREMENTS_MET' ELSE 'UNMEASURED' END AS verdict, first_page,
  u < 2 AS g1, CASE WHEN i = 0 THEN true ELSE c < i END AS g4, only_map AS g5, i >= 2 AND u = 1 AS g8 FROM mq)"""
_UNMET = "array_to_string(list_filter([CASE WHEN {g1} THEN 'sufficient sample diversity' END, CASE WHEN {g2} THEN 'fact coverage' END, CASE WHEN {g3} THEN 'semantic distinctness' END, CASE WHEN {g4} THEN 'canonical strategy' END, CASE WHEN {g5} THEN 'discovery support beyond sitemap' END, CASE WHEN {g6} THEN 'claim integrity' END, CASE WHEN {g7} THEN 'demand evidence' END, CASE WHEN {g8} THEN 'cannibalization risk' END, CASE WHEN {g5} THEN 'internal link support' END, CASE WHEN {g10} THEN 'doorway risk' END, CASE WHEN {g11} THEN 'conversion readiness' END], lambda x: x IS NOT NULL), ', ')"
_RENDER = f"""{_SITE}, rd AS (SELECT CASE WHEN b = 3 THEN url || '#r' WHEN b = 6 THEN regexp_replace(url, '^[a-z]+://[^/]+', 'https://copy.example') WHEN k = 6 THEN url || '/gone' ELSE url END AS r_url, CASE WHEN k = 5 THEN 'other' WHEN k <> 4 THEN trim(ti) END AS r_title, CASE WHEN b = 2 THEN url WHEN b = 4 THEN 'x' END AS r_canon,
  CASE WHEN j = 1 THEN 'Other' WHEN b = 4 THEN 'h' WHEN b = 5 THEN 'One' ELSE coalesce(title, 'h') END AS r_h1, j = 0 AS r_type FROM ap),
rq AS (SELECT *, regexp_replace(r_url, '#.*$', '') AS ru, coalesce(nullif(regexp_extract(r_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS rp FROM rd),
fp AS (SELECT path AS fpath, arg_min(url, ordinal) AS furl FROM ap GROUP BY 1),
mt AS (SELECT r_url, r_title, r_canon, r_h1, r_type, p.* FROM rq LEFT JOIN ap e ON e.url = rq.ru LEFT JOIN fp ON fp.fpath = rq.rp LEFT JOIN ap p ON p.url = coalesce(e.url, fp.furl)),
cp AS (SELECT *, CASE WHEN b = 4 THEN NULL WHEN b = 5 THEN 'One' ELSE coalesce(title, 'h') END AS h1, coalesce(canonical, path) AS can, coalesce(nullif(regexp_extract(coalesce(canonical, path), '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), CASE WHEN canonical LIKE '%://%' THEN '/' ELSE path END) AS cpath, coalesce(nullif(regexp_extract(r_canon, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), r_canon) AS rpath FROM mt WHERE url IS NOT NULL AND (ix = 'indexable' OR status = 200))"""


def _render_rule(code: str, severity: str, source: str, cond: str, subject: str) -> str:
    return _rule(f"RENDER-{code}", severity, source, cond, subject, "r_url")


_RENDER_RULES = " UNION ".join([
    _render_rule("007", "info", "mt", "url IS NULL", "r_url"), _render_rule("003", "warn", "cp", "r_title IS NOT NULL AND coalesce(trim(ti), '') <> r_title", "r_url || ':title'"),
    _render_rule("004", "warn", "cp", "r_canon IS NOT NULL AND can <> r_canon AND cpath <> rpath", "r_url || ':canonical'"), _render_rule("005", "warn", "cp", "coalesce(h1, '') <> r_h1", "r_url || ':h1'"), _render_rule("006", "warn", "cp", "r_type", "r_url || ':WebPage'"),
])
_SHAPES = f"""{_SITE}, sq AS (SELECT *, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS sg, lower(path) AS lp FROM ap),
tt AS ({" UNION ALL ".join(f"SELECT DISTINCT host, url, 'archetype' AS trait, '{n}' AS value, 1 AS n FROM sq WHERE contains(lp, '{t}')" for t, n in [("/blog", "blog"), ("/category", "category"), ("/service", "service"), ("/faq", "faq"), ("/price", "pricing"), ("/review", "reviews"), ("/about", "about"), ("/specialist", "profile"), ("/pro", "pro"), ("/city", "city"), ("/guide", "guide"), ("/docs", "docs"), ("/compare", "compare")])}
  UNION ALL SELECT host, url, 'archetype', 'faq', 0 FROM sq WHERE b NOT IN (4, 5) AND contains(lower(coalesce(title, 'h')), 'faq') UNION ALL SELECT host, url, 'archetype', 'faq', 1 FROM sq WHERE j = 4 AND b < 5 UNION ALL SELECT host, url, 'archetype', 'local_business', 1 FROM sq WHERE j = 4 AND b >= 5
  UNION ALL SELECT host, url, 'prefix', '/' || array_to_string(sg[:2], '/'), 1 FROM sq WHERE len(sg) > 0
  UNION ALL SELECT host, url, 'schema', CASE WHEN j = 2 THEN 'Organization' WHEN j = 3 THEN 'https://schema.org/Product' WHEN b < 5 THEN 'FAQPage' ELSE 'LocalBusiness' END, 1 FROM sq WHERE j >= 2
  UNION ALL SELECT host, url, 'locale', 'en', 1 FROM sq WHERE has_lang UNION ALL SELECT host, url, 'locale', unnest(CASE n_alt WHEN 2 THEN ['de', 'fr'] WHEN 1 THEN ['en'] ELSE [] END), 1 FROM sq),
shp AS (SELECT regexp_replace(host, ':.*$', '') AS site, trait, value, sum(n)::BIGINT AS n FROM tt GROUP BY 1, 2, 3)"""
SQL: dict[str, str] = {
    "market_pages": f"WITH {_MARKET} SELECT coalesce(market, 'unknown') AS market, count(*) AS n_pages FROM mk GROUP BY 1",
    "market_rules": f"WITH {_MARKET}, h AS (SELECT url, array_to_string({_by_market(False)}, ',') AS v FROM mk WHERE status < 400) " + _rule("MARKET-001", "error", "h", "v <> ''", "v") + " UNION ALL SELECT 'SE-MARKET-001', 'MARKET', 'error', 'src/kestrel.ts', 'north: Tarnhaven'",
    "claim_rules": f"WITH {_MARKET}, c AS (SELECT url FROM mk WHERE status < 400 AND market = 'de' AND (contains(text, 'hedge-care') OR contains(text, 'hedge-trim'))) " + _rule("CLAIM-001", "error", "c", "true", "'hedge'"),
    "claim_facts": "SELECT 'north' AS pack, 'hedge_verified' AS field, 'src/kestrel.ts' AS path, 2 AS line UNION ALL SELECT 'north', 'hedge_verified', 'src/plain.ts', 1",
    "entity_rules": f"""WITH {_MARKET}, m AS (SELECT host, url, ordinal, {_by_market(True)} AS m FROM mk WHERE status = 200 AND ix = 'indexable' AND NOT pdf), sz AS (SELECT host, count(*) AS n FROM ok WHERE htm GROUP BY 1), x AS (SELECT * FROM m WHERE len(m) > 0),
      c AS (SELECT host, label, count(*) AS c FROM (SELECT host, unnest(m) AS label FROM x) GROUP BY 1, 2), ch AS (SELECT host, list_sort(list(label)) AS ch FROM c JOIN sz USING (host) WHERE n >= 3 AND c >= ceil(n / 2) GROUP BY 1), f AS (SELECT host, arg_min(url, ordinal) AS url FROM x GROUP BY 1),
      a AS (SELECT url, host || ':chrome:' || array_to_string(ch, ',') AS v FROM ch JOIN f USING (host)), o AS (SELECT url, array_to_string(list_filter(m, lambda l: NOT list_contains(coalesce(ch, []), l)), ',') AS v FROM x LEFT JOIN ch USING (host)) """
    + _rule("ENTITY-001", "warn", "a", "true", "v") + " UNION ALL " + _rule("ENTITY-001", "warn", "o", "v <> ''", "v"),
    "town_rules": f"WITH {_SITE} " + _rule("ENTITY-002", "warn", "ok", "htm AND contains(path, '/services/') AND NOT (j = 4 AND b >= 5)", "path") + " UNION ALL " + _rule("LOCAL-001", "warn", "ok", "htm AND contains(path, '/services/') AND j = 4 AND b >= 5 AND l % 2 = 0"),
    "render_rules": f"WITH {_RENDER} {_RENDER_RULES}",
    "render_states": f"WITH {_RENDER}, f AS ({_RENDER_RULES}), g AS (SELECT url, bool_or(code = 'SE-RENDER-007') AS only_r FROM f GROUP BY 1) SELECT CASE WHEN only_r IS NULL THEN 'expected' WHEN only_r THEN 'render_only' ELSE 'contradicted' END AS state, count(*) AS n_urls FROM (SELECT DISTINCT r_url FROM rd) LEFT JOIN g ON g.url = r_url GROUP BY 1",
    "family_shares": f"WITH {_TOWNS} SELECT * FROM sh",
    "family_rules": f"WITH {_TOWNS}, s AS (SELECT family AS f, first_page FROM sh WHERE measured_urls >= 2 AND template_shared_ratio >= 70 AND unique_fact_ratio < 15) " + _rule("CONTENT-003", "warn", "s", "true", "f", "first_page") + " UNION ALL " + _rule("PROG-002", "warn", "th", "true", "fam || ':' || n"),
    "matrix_compiled": f"WITH {_COMPILED} SELECT family, measured_urls, n_indexable, n_unique, estimated_cardinality, measured_sample_rate, canonical_coverage, internal_discovery, cannibalization_risk, semantic_distinctness, verdict, first_page, {_UNMET.format(g1='g1', g2='true', g3='true', g4='g4', g5='g5', g6='false', g7='false', g8='g8', g10='false', g11='false')} AS unmet FROM cm UNION ALL SELECT '/:locale/category/:city', 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, 'UNMEASURED', NULL, 'sufficient sample diversity, fact coverage, semantic distinctness, canonical strategy'",
    "matrix_enriched": f"""WITH {_COMPILED}, mk AS (SELECT turl, fam, CASE WHEN host LIKE '%.test' THEN 'test' WHEN contains(path, '/de/') THEN 'de' WHEN contains(path, '/fr/') THEN 'fr' WHEN contains(lower(text), 'kayak') THEN 'de' END AS market, text, status FROM tf), cl AS (SELECT fam, count(*) AS hits FROM mk WHERE status < 400 AND market = 'de' AND (contains(text, 'hedge-care') OR contains(text, 'hedge-trim')) GROUP BY 1),
      dp AS (SELECT list_filter(string_split(regexp_replace(coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/'), '{_SLUG}', '/services/\\1/\\2'), '/'), lambda x: x <> '') AS sg, gsc_clicks, gsc_impressions FROM pages), dr AS (SELECT CASE WHEN sg[1] IN ('en', 'ru', 'he', 'es', 'fr', 'de') THEN sg[2:] ELSE sg END AS r, gsc_clicks, gsc_impressions FROM dp),
      de AS (SELECT 'category/' || r[2] AS family, sum(gsc_clicks)::BIGINT AS gsc_clicks, sum(gsc_impressions)::BIGINT AS gsc_impressions FROM dr WHERE r[1] IN ('category', 'services') AND (len(r) = 2 OR (len(r) = 3 AND (contains(r[3], '-') OR strlen(r[3]) >= 4))) GROUP BY 1),
      ran AS (SELECT count(*) > 0 AS ran FROM ap WHERE status < 400 AND NOT host LIKE '%.test' AND (contains(path, '/de/') OR (NOT contains(path, '/fr/') AND contains(lower(text), 'kayak'))) AND (contains(text, 'hedge-care') OR contains(text, 'hedge-trim'))),
      al AS (SELECT family, g1, g4, g5, g8, verdict, measured_urls, semantic_distinctness AS sd FROM cm UNION ALL SELECT '/:locale/category/:city', true, true, false, false, 'UNMEASURED', 0, NULL),
      e AS (SELECT al.*, s.local_fact_coverage AS fact_coverage, s.unique_fact_ratio, s.template_shared_ratio AS boilerplate_ratio, coalesce(CASE WHEN s.unique_semantic_ratio IS NOT NULL THEN least(s.unique_semantic_ratio + coalesce(s.unique_fact_ratio, 0), 100) END, sd)::INT AS semantic_distinctness, s.schema_fact_coverage,
        CASE WHEN s.template_shared_ratio >= 70 AND s.unique_fact_ratio < 15 THEN 80 WHEN s.template_shared_ratio >= 70 THEN 55 WHEN s.unique_fact_ratio >= 15 THEN 20 END AS doorway_risk, gsc_clicks, gsc_impressions, coalesce(hits, 0) AS hits, s.family IS NOT NULL AS seen FROM al LEFT JOIN sh s ON s.family = al.family LEFT JOIN de ON de.family = al.family LEFT JOIN cl ON cl.fam = al.family)
      SELECT family, CASE WHEN verdict = 'SAFE_IF_REQUIREMENTS_MET' AND measured_urls >= 2 AND NOT g1 AND NOT g4 AND coalesce(fact_coverage >= 40, false) AND coalesce(unique_fact_ratio >= 15, false) THEN 'SAFE_TO_GENERATE' ELSE verdict END AS verdict, fact_coverage, unique_fact_ratio, boilerplate_ratio, semantic_distinctness, doorway_risk, schema_fact_coverage,
      CASE WHEN gsc_impressions > 0 THEN 100 WHEN gsc_impressions IS NOT NULL THEN 0 END AS demand_coverage, CASE WHEN ran THEN greatest(100 - 20 * hits, 0)::INT END AS claim_integrity, gsc_clicks, gsc_impressions,
      {_UNMET.format(g1='g1', g2='NOT coalesce(fact_coverage >= 40, false)', g3='NOT coalesce(unique_fact_ratio >= 15, false)', g4='g4', g5='g5', g6='ran AND hits > 0', g7='gsc_impressions = 0', g8='g8', g10='doorway_risk >= 70', g11='schema_fact_coverage < 40')} AS unmet FROM e, ran""",
    "site_shapes": f"WITH {_SHAPES} SELECT * FROM shp",
    "competitor_gaps": f"""WITH {_SHAPES}, own AS (SELECT min(regexp_replace(host, ':.*$', '')) AS own FROM ap), o AS (SELECT trait, value, n FROM shp, own WHERE site = own), t AS (SELECT s.*, coalesce(o.n, 0) AS on_, o.n IS NOT NULL AS has FROM shp s LEFT JOIN o USING (trait, value), own WHERE site <> own),
      tot AS (SELECT regexp_replace(host, ':.*$', '') AS site, count(*) FILTER (status = 200 AND ix = 'indexable') AS i, count(*) FILTER (status = 200 AND ix = 'indexable' AND n_h1 > 0) AS h FROM ap GROUP BY 1), ln AS (SELECT regexp_extract(src, '^[a-z]+://([^/?#:]*)', 1) AS site, count(*) AS n FROM (SELECT edge_id, src, dst, location FROM ed) GROUP BY 1),
      tl AS (SELECT tot.*, coalesce(ln.n, 0) AS links FROM tot LEFT JOIN ln USING (site)), me AS (SELECT tl.* FROM tl, own WHERE site = own)
      SELECT 'cluster_gap' AS kind, min(site) || ':' || value AS subject FROM t WHERE trait = 'archetype' AND NOT has GROUP BY value
      UNION ALL SELECT 'cluster_gap', site || ':prefix:' || value FROM t WHERE trait = 'prefix' AND NOT has AND NOT contains(value, '/blog/') AND NOT contains(value, '/category/') AND NOT regexp_matches(value, '^/[^/]+/([0-9]+|[0-9A-Fa-f]{{8,}})$')
      UNION ALL SELECT 'market_gap', site || ':locale:' || value FROM t WHERE trait = 'locale' AND NOT has UNION ALL SELECT DISTINCT 'schema_gap', value FROM t WHERE trait = 'schema' AND NOT has
      UNION ALL SELECT 'cluster_gap', site || ':' || value || ':cardinality' FROM t WHERE trait = 'archetype' AND n >= 4 AND n > on_ * 2 + 2
      UNION ALL SELECT 'link_gap', tl.site FROM tl, me WHERE tl.site <> me.site AND tl.links > 2 * me.links AND tl.links >= 8 UNION ALL SELECT 'content_gap', tl.site FROM tl, me WHERE tl.site <> me.site AND tl.i > 0 AND me.i > 0 AND tl.h * 2 > tl.i AND me.h * 2 < me.i""",
}
_PLACED = f"regexp_replace(url, '{_SLUG}', '/services/\\1/\\2')"
_ITEMS = f"""{_COMPILED}, te AS (SELECT DISTINCT regexp_replace(src, '{_SLUG}', '/services/\\1/\\2') AS src, regexp_replace(dst, '{_SLUG}', '/services/\\1/\\2') AS dst FROM ed),
wa AS (SELECT *, '/' || array_to_string(sg, '/') || CASE WHEN path LIKE '%/' AND len(sg) > 0 THEN '/' ELSE '' END AS tpath FROM tw),
bf(node, depth) USING KEY (node) AS (SELECT turl, 0 FROM wa WHERE path = '/' UNION SELECT e.dst, b.depth + 1 FROM bf b JOIN te e ON e.src = b.node LEFT JOIN recurring.bf r ON r.node = e.dst WHERE r.node IS NULL),
it AS (SELECT 'link_gap' AS kind, turl AS subject, turl || ' is indexable but has no internal inlinks from the seed' AS summary FROM wa LEFT JOIN bf ON bf.node = turl WHERE status = 200 AND ix = 'indexable' AND depth IS NULL AND path <> '/'
  UNION ALL SELECT 'sitemap_gap', turl, turl || ' is linked and indexable but absent from the sitemap' FROM wa WHERE status = 200 AND ix = 'indexable' AND NOT in_map AND inbound > 0 UNION ALL SELECT 'content_gap', turl, turl || ' has no H1' FROM wa WHERE status = 200 AND ix = 'indexable' AND n_h1 = 0
  UNION ALL SELECT 'cannibal', family, family || ' variants should be consolidated' FROM cm WHERE verdict = 'CONSOLIDATE' UNION ALL SELECT 'create_family', family, family || ' needs unique facts before expansion' FROM (SELECT family, verdict FROM cm UNION ALL SELECT '/:locale/category/:city', 'UNMEASURED') WHERE verdict = 'SAFE_IF_REQUIREMENTS_MET' OR (verdict = 'UNMEASURED' AND contains(family, ':'))
  UNION ALL SELECT 'noindex', family, family || ' should stay out of the index by default' FROM cm WHERE verdict = 'NOINDEX_BY_DEFAULT')"""
_CURX = _CUR.replace("status, bot_role,\n", "status, bot_role, difficulty, serp_features,\n").replace("bot_role DESC NULLS LAST)", "bot_role DESC NULLS LAST, difficulty DESC NULLS LAST, array_to_string(serp_features, '|') DESC NULLS LAST)")
_DECORATED = f"""{_ITEMS}, {_CURX}, ob AS (SELECT *, rtrim({_PLACED}, '/') AS pu, array_to_string(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'), ' ') AS qw, CASE WHEN kind = 'serp_position' THEN 8 + CASE WHEN position <= 3 THEN 10 ELSE 0 END ELSE 0 END + CASE WHEN len(list_filter(serp_features, lambda f: contains(f, 'ai_overview') OR f = 'paa')) > 0 THEN 6 ELSE 0 END AS boost FROM cur),
se AS (SELECT pu, sum(impressions)::BIGINT AS i, sum(clicks)::BIGINT AS c, min(position) AS position, min(position) FILTER (position > 0)::DOUBLE AS best FROM ob WHERE kind = 'search_performance' AND url IS NOT NULL GROUP BY 1),
ik AS (SELECT *, rtrim(subject, '/') AS k, ' ' || array_to_string(regexp_extract_all(lower(subject), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS sw, ' ' || array_to_string(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS mw FROM it),
ma AS (SELECT kind, subject, max(difficulty) AS dif, sum(boost)::BIGINT AS boost FROM (SELECT DISTINCT ik.kind, ik.subject, row_id, difficulty, boost FROM ik JOIN ob o ON o.kind IN ('keyword_volume', 'serp_position', 'serp_feature') AND (o.pu = ik.k OR (qw <> '' AND len(string_split(qw, ' ')) <= 8 AND (contains(sw, ' ' || qw || ' ') OR contains(mw, ' ' || qw || ' '))))) GROUP BY 1, 2),
ow AS (SELECT rtrim(turl, '/') AS k, max(inbound) AS inb, max(inbound / 100) AS r, max(max(inbound / 100)) OVER () AS top FROM wa GROUP BY 1),
dc0 AS (SELECT ik.kind, ik.subject, i, c, best, position, dif, boost, inb, r, top, CASE WHEN i > 0 OR best IS NOT NULL THEN least(i // 10, 100)::INT END AS demand, CASE WHEN i > 0 OR best IS NOT NULL THEN CASE WHEN best > 10 THEN round(least((best - 10) * 5, 100))::INT ELSE 0 END END AS visibility_gap,
  CASE ik.kind WHEN 'create_family' THEN 55 WHEN 'cannibal' THEN 50 WHEN 'noindex' THEN 25 WHEN 'content_gap' THEN 28 WHEN 'sitemap_gap' THEN 12 WHEN 'link_gap' THEN 18 ELSE 35 END AS cost FROM ik LEFT JOIN se ON se.pu = ik.k LEFT JOIN ma ON ma.kind = ik.kind AND ma.subject = ik.subject LEFT JOIN ow ON ow.k = ik.k),
dc AS (SELECT kind, subject, demand, visibility_gap, CASE WHEN i > 0 THEN i END AS raw_impressions, CASE WHEN i > 0 THEN c END AS raw_clicks, CASE WHEN i > 0 AND position IS NOT NULL THEN round({_CTR} * 100)::INT END AS expected_ctr,
  CASE WHEN i > 0 THEN CASE WHEN position IS NOT NULL THEN greatest(round(i * {_CTR})::BIGINT - c, 0) WHEN visibility_gap IS NOT NULL THEN visibility_gap * (greatest(i, 1) // 100) END END::BIGINT AS recoverable_clicks, cost, CASE WHEN inb = 0 THEN 80 WHEN inb > 0 THEN least(20 + 8 * inb, 80) WHEN kind = 'link_gap' THEN 80 END::INT AS leverage,
  CASE WHEN dif IS NOT NULL OR boost > 0 THEN least(greatest(coalesce(dif, 40) + least(coalesce(boost, 0), CASE WHEN dif IS NOT NULL THEN 25 ELSE 40 END) - CASE WHEN top > 0 THEN round(30 * coalesce(r, 0) / top) ELSE 0 END, 0), 100)::INT END AS difficulty_to_rank FROM dc0)"""
_MADE = f"pr AS (SELECT list_filter(string_split(regexp_replace(coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/'), '{_SLUG}', '/services/\\1/\\2'), '/'), lambda x: x <> '') AS sg, producer_key, producer_hash FROM pages WHERE regexp_matches(producer_hash, '^[0-9]')), ps AS (SELECT CASE WHEN sg[1] IN ('en', 'ru', 'he', 'es', 'fr', 'de') THEN sg[2:] ELSE sg END AS r, producer_key, producer_hash FROM pr), mad AS (SELECT DISTINCT 'category/' || r[2] AS family, producer_key AS path, producer_hash AS hash FROM ps WHERE r[1] IN ('category', 'services') AND (len(r) = 2 OR (len(r) = 3 AND (contains(r[3], '-') OR strlen(r[3]) >= 4))))"
_FAMILY_OF = "sf AS (SELECT DISTINCT turl, fam FROM tf)"
_TARGETS = f"{_ITEMS}, {_MADE}, {_FAMILY_OF}, ac AS (SELECT DISTINCT subject, CASE kind WHEN 'link_gap' THEN 'LINK' WHEN 'cannibal' THEN 'CONSOLIDATE' WHEN 'create_family' THEN 'CREATE' WHEN 'noindex' THEN 'NOINDEX' ELSE 'IMPROVE' END AS action, coalesce(fam, subject) AS family FROM it LEFT JOIN sf ON sf.turl = it.subject), ho AS (SELECT path, subject, min(action) AS action, min(hash) AS hash FROM ac JOIN mad USING (family) WHERE NOT starts_with(path, '@') AND path <> 'import' GROUP BY 1, 2)"
SQL |= {
    "opportunity_axes": f"WITH RECURSIVE {_DECORATED} SELECT *, (recoverable_clicks * 2500 // greatest(cost, 1))::BIGINT AS expected_value FROM dc",
    "opportunity_build": f"WITH RECURSIVE {_DECORATED}, {_MADE}, {_FAMILY_OF}, x AS (SELECT dc.*, coalesce(fam, subject) AS family FROM dc LEFT JOIN sf ON sf.turl = dc.subject), y AS (SELECT x.kind, x.subject, cost, leverage, s.family IS NOT NULL AS has, unique_fact_ratio AS u, local_fact_coverage AS l, x.family IN (SELECT family FROM mad) AS made FROM x LEFT JOIN sh s ON s.family = x.family) SELECT kind, subject, least(greatest(cost + coalesce((100 - u) // 4, 0) - coalesce(l // 5, 0) - CASE WHEN has AND made THEN 12 ELSE 0 END - CASE WHEN made THEN 8 ELSE 0 END - coalesce(leverage // 5, 0), 0), 100)::INT AS difficulty_to_build FROM y",
    "plan_handoff": f"WITH RECURSIVE {_TARGETS} SELECT * FROM ho",
    "plan_stale": f"WITH RECURSIVE {_TARGETS}, nw AS (SELECT path, min(CASE WHEN length(path) % 2 = 0 THEN '0' ELSE hash END) AS now_ FROM mad WHERE length(path) % 3 > 0 GROUP BY 1) SELECT DISTINCT h.path, CASE WHEN now_ IS NULL THEN 'gone' ELSE 'hash changed' END AS reason FROM ho h LEFT JOIN nw USING (path) WHERE now_ IS NULL OR now_ <> h.hash",
    "plan_waits": f"WITH RECURSIVE {_ITEMS} SELECT DISTINCT l.subject, 'OBSERVE_GSC' AS waits_for FROM it l WHERE l.kind = 'link_gap' AND EXISTS (SELECT 1 FROM it c WHERE c.subject = l.subject AND (c.kind = 'create_family' OR (c.kind = 'content_gap' AND length(c.subject) % 2 = 0)))",
    "producer_changes": "WITH " + _CHANGES.replace("SELECT DISTINCT snapshot_id, 'page' AS record_kind, url AS record_key, regexp_replace(lower(trim(content_hash)), '^(?:[a-z0-9-]+:|0x)', '') AS v FROM pages\n  UNION SELECT DISTINCT snapshot_id, 'finding', fingerprint, '' FROM findings", "SELECT DISTINCT snapshot_id, 'producer' AS record_kind, producer_key AS record_key, producer_hash AS v FROM pages WHERE producer_key IS NOT NULL")
    .replace("WHERE n.v IS DISTINCT FROM o.v)", "GROUP BY 1, 2, 3 HAVING list_sort(list_distinct(list(n.v))) IS DISTINCT FROM list_sort(list_distinct(list(o.v))))") + " SELECT snapshot_id, record_key, change FROM changes",
}
