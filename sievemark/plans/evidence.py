"""Queries over URLs, texts and provider observations, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import content as C
from ..operators import observations as O
from ..operators.common import table
from ..sources.imports import agent_of, listed_agents


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "lang", "source")


def _rows(s: SparkSession, d: str) -> DataFrame:
    return O.current_rows(table(s, d, "observations"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of the latest filled snapshot of each site, each URL once."""
    pages = table(s, d, "pages")
    runs = table(s, d, "runs").select(U.without_slashes(F.col("site")).alias("site"), "snapshot_id", "recorded_at").join(pages.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    last = runs.groupBy("site").agg(F.max(F.struct("recorded_at", "snapshot_id")).alias("m")).select(F.col("m.snapshot_id").alias("snapshot_id"))
    return pages.join(last, "snapshot_id", "left_semi").groupBy("url").agg(F.min("indexable").alias("indexable"), F.max("inbound").alias("inbound"), F.min("status").alias("status"))


# ---- URLs
def url_parts(s: SparkSession, d: str) -> DataFrame:
    """Parts of every page URL."""
    return table(s, d, "pages").select("url").distinct().select("url", U.url_parts(F.col("url")).alias("p")).select("url", "p.scheme", "p.host", "p.path", "p.query", U.origin(F.col("p")).alias("origin"), U.request_target(F.col("p")).alias("target"), U.same_origin(F.col("p"), U.url_parts(U.join_url(F.col("url"), F.lit("/x")))).alias("keeps_origin"))


def url_shapes(s: SparkSession, d: str) -> DataFrame:
    """Locale, family, prefix, city shape and city family of every page URL."""
    p = table(s, d, "pages").select("url").distinct().withColumn("path", U.url_path(F.col("url")))
    c = U.city_family(F.col("path"))
    return p.select("url", U.locale_of(F.col("path")).alias("locale"), U.url_family(F.col("url")).alias("family"), U.path_prefix(F.col("path")).alias("prefix"), U.city_shaped(F.col("path")).alias("city_shaped"), c["family"].alias("city_family"), c["city"].alias("city"))


def url_archetypes(s: SparkSession, d: str) -> DataFrame:
    """Pages per archetype of the path."""
    p = table(s, d, "pages").select("url").distinct()
    return p.select(F.explode(U.archetypes(U.url_path(F.col("url")))).alias("archetype")).groupBy("archetype").agg(F.count(F.lit(1)).alias("n_urls"))


def locale_twins(s: SparkSession, d: str) -> DataFrame:
    """Paths of a host that exist under two or more locales."""
    p = table(s, d, "pages").select("url").distinct().select(U.url_parts(F.col("url")).alias("p")).select("p.host", "p.path")
    loc = U.locale_of(F.col("path"))
    rest = F.when(loc.isNull(), F.col("path")).otherwise(F.concat(F.lit("/"), F.regexp_replace(F.substr(F.col("path"), F.length(loc) + 2), "^/+", "")))
    g = p.select("host", rest.alias("rest"), F.coalesce(loc, F.lit("")).alias("loc")).groupBy("host", "rest").agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("loc").alias("n_locales"))
    return g.where("n_pages >= 2 AND n_locales >= 2")


# ---- texts
def doc_profile(s: SparkSession, d: str) -> DataFrame:
    """Token shares of every document."""
    return C.token_profile(_docs(s, d))


def doc_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentence lengths of every document."""
    return C.sentence_stats(_docs(s, d))


def doc_lexical(s: SparkSession, d: str) -> DataFrame:
    """Entropy, moving type-token share and lexical diversity of every document."""
    return C.lexical_measures(_docs(s, d))


def doc_levels(s: SparkSession, d: str) -> DataFrame:
    """Levels of redundancy, cohesion, genericity and specificity of every document."""
    return C.text_profile(_docs(s, d)).select("doc_id", "redundancy", "cohesion", "genericity_band", "specificity_band", "sentence_variance", "authorship")


def intent_sources(s: SparkSession, d: str) -> DataFrame:
    """Intents that the documents of each source answer together."""
    return C.intent_totals(_docs(s, d), F.coalesce("source", F.lit("(none)")))


def doc_chunks(s: SparkSession, d: str) -> DataFrame:
    """Scored sentence chunks of every document."""
    return C.sentence_chunks(_docs(s, d))


def doc_intents(s: SparkSession, d: str) -> DataFrame:
    """Answered intent phrases of every document."""
    return C.intent_coverage(_docs(s, d))


def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Documents whose text occurs more than once."""
    return C.exact_duplicates(_docs(s, d))


def shared_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """Vocabulary that all documents of a source share."""
    return C.shared_vocabulary(_docs(s, d), F.col("source"))


# ---- observations
def obs_url_metrics(s: SparkSession, d: str) -> DataFrame:
    """Clicks, impressions and citations per URL."""
    return O.url_metrics(_rows(s, d))


def obs_demand_axes(s: SparkSession, d: str) -> DataFrame:
    """Demand and visibility gap per URL."""
    return O.demand_axes(_rows(s, d))


def obs_ctr_gap(s: SparkSession, d: str) -> DataFrame:
    """Rows that get fewer clicks than their position promises."""
    return O.ctr_gaps(_rows(s, d))


def obs_striking_distance(s: SparkSession, d: str) -> DataFrame:
    """Rows just below the first places."""
    return O.striking_distance(_rows(s, d), _pages(s, d))


def obs_decay(s: SparkSession, d: str) -> DataFrame:
    """URLs that lost clicks against the previous window."""
    return O.decay(_rows(s, d))


def obs_cannibalization(s: SparkSession, d: str) -> DataFrame:
    """Queries that several URLs compete for."""
    return O.query_cannibalization(_rows(s, d))


def obs_demand_without_page(s: SparkSession, d: str) -> DataFrame:
    """Demand for URLs that weren't crawled."""
    return O.demand_without_page(_rows(s, d), _pages(s, d))


def obs_demand_without_bots(s: SparkSession, d: str) -> DataFrame:
    """Demand for crawled URLs that no bot visits."""
    return O.demand_without_bots(_rows(s, d), _pages(s, d))


def obs_bot_findings(s: SparkSession, d: str) -> DataFrame:
    """Bot visits to errors, closed pages, pages without demand and orphans."""
    return O.bot_findings(_rows(s, d), _pages(s, d))


def obs_ai_funnel(s: SparkSession, d: str) -> DataFrame:
    """From discovery over citation to referral, per URL."""
    return O.ai_funnel(_rows(s, d))


def obs_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Global outcome metrics."""
    return O.outcome_metrics(_rows(s, d))


def obs_citation_drops(s: SparkSession, d: str) -> DataFrame:
    """Citations of the previous window that are gone."""
    return O.citation_drops(_rows(s, d))


def obs_kinds(s: SparkSession, d: str) -> DataFrame:
    """Rows per provider, with the kind that the provider's name implies."""
    r = _rows(s, d)
    return r.groupBy("provider", O.parse_kind(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"), F.first(O.provider_kind(F.col("provider"))).alias("implied_kind"))


def agent_tokens(s: SparkSession, d: str) -> DataFrame:
    """Rows per listed crawler by the longest token that a user agent contains."""
    a = table(s, d, "ai_agents").select("token", "role")
    ua = _rows(s, d).where("user_agent IS NOT NULL").groupBy("user_agent").agg(F.count(F.lit(1)).alias("n"))
    return ua.select("n", agent_of(F.col("user_agent"), listed_agents(a))["token"].alias("token")).where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n_rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        url_parts, url_shapes, url_archetypes, locale_twins, doc_profile, doc_sentences, doc_lexical, doc_levels, doc_chunks, doc_intents, intent_sources, exact_duplicates, shared_vocabulary,
        obs_url_metrics, obs_demand_axes, obs_ctr_gap, obs_striking_distance, obs_decay, obs_cannibalization, obs_demand_without_page, obs_demand_without_bots, obs_bot_findings, obs_ai_funnel,
        obs_outcomes, obs_citation_drops, obs_kinds, agent_tokens,
    )
}

# ---- SQL
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOK = f"list_filter(string_split_regex({_AZ.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2)"
_FACTS = ", ".join(f"'{w}'" for w in T.FACT_WORDS)
_FUNCTION = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
_WS = "[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{0085}}\\x{{1680}}]"
_UWORDS = "list_filter(string_split_regex({}, '" + _WS + "+'), lambda x: x <> '')"
_SENT = "list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda s: regexp_replace(s, '^" + _WS.replace("{{", "{").replace("}}", "}") + "+|" + _WS.replace("{{", "{").replace("}}", "}") + "+$', '', 'g')), lambda s: len(" + _UWORDS.format("s") + ") >= 3)"
_KEYS = "kind, query, url, provider, clicks, impressions, hits, position, period, user_agent, status, bot_role"
_CUR = f"""cur AS (SELECT row_id, kind, query, url, provider, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, coalesce(hits, 0) AS hits, position, period, user_agent, status, bot_role,
  CASE WHEN lower(period) LIKE '%prev%' OR lower(period) LIKE '%prior%' OR lower(period) LIKE '%before%' THEN 'previous' WHEN lower(period) LIKE '%yoy%' OR lower(period) LIKE '%year%' THEN 'yoy' ELSE 'current' END AS bucket,
  regexp_replace(url, '/+$', '') AS page_url
  FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in _KEYS.split(', '))}) AS rn FROM observations) WHERE rn = 1)"""
_PAGES = """filled AS (SELECT DISTINCT rtrim(site, '/') AS site, snapshot_id, recorded_at FROM runs WHERE snapshot_id IN (SELECT snapshot_id FROM pages)),
last AS (SELECT snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY recorded_at DESC, snapshot_id DESC) AS rn FROM filled) WHERE rn = 1),
pg AS (SELECT url, min(indexable) AS indexable, max(inbound) AS inbound, min(status) AS status FROM pages WHERE snapshot_id IN (SELECT snapshot_id FROM last) GROUP BY url),
measured AS (SELECT DISTINCT regexp_replace(url, '/+$', '') AS page_url FROM pg),
sums AS (SELECT page_url, sum(CASE WHEN kind = 'bot_crawl' THEN hits ELSE 0 END) AS hits, sum(CASE WHEN kind = 'search_performance' THEN impressions ELSE 0 END) AS impressions FROM cur WHERE url IS NOT NULL GROUP BY 1)"""
_CTR = "(CASE " + " ".join(f"WHEN position <= {t} THEN {c}::FLOAT::DOUBLE" if t else f"ELSE {c}::FLOAT::DOUBLE" for t, c in [(1, 0.28), (2, 0.15), (3, 0.11), (4, 0.08), (5, 0.06), (7, 0.04), (10, 0.025), (20, 0.012), (None, 0.005)]) + " END)"
_PATH = "coalesce(nullif(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ''), '/')"
_SEGS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
_LOC = "('" + "', '".join(U.PAGE_LOCALES) + "')"
_FLOC = "('" + "', '".join(U.FAMILY_LOCALES) + "')"
_KIND_CASE = "CASE " + " ".join(f"WHEN provider IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in O.PROVIDER_KINDS.items()) + " ELSE 'analytics' END"

_LEXICAL = f"""e AS (SELECT doc_id, unnest({_TOK}) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, t, count(*) AS c FROM e GROUP BY 1, 2), g AS (SELECT doc_id, sum(c) AS n, count(*) AS k, sum(c * log2(c)) AS s FROM c GROUP BY 1),
  w AS (SELECT doc_id, {_TOK} AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, t, len(t) AS n, list_reduce(list_transform(t, lambda x: {{'f': 0, 'r': 1, 's': [x]}}), lambda a, x: CASE WHEN a.r + 1 >= 10 AND len(list_distinct(list_concat(a.s, x.s))) * 100 // (a.r + 1) < 72 THEN {{'f': a.f + 1, 'r': 0, 's': []::VARCHAR[]}} ELSE {{'f': a.f, 'r': a.r + 1, 's': list_distinct(list_concat(a.s, x.s))}} END, {{'f': 0, 'r': 0, 's': []::VARCHAR[]}}).f AS f FROM w WHERE len(t) > 0),
  lex AS (SELECT g.doc_id, CASE WHEN g.k = 1 THEN 0 ELSE round(least(greatest((log2(g.n) - g.s / g.n) / log2(g.k) * 100, 0), 100))::INT END AS term_entropy,
  least(100, CASE WHEN m.n < 50 THEN len(list_distinct(t)) * 100 // m.n ELSE list_sum(list_transform(range(1, m.n - 48), lambda i: len(list_distinct(t[i:i + 49]))))::BIGINT * 100 // ((m.n - 49) * 50) END)::INT AS mattr,
  CASE WHEN m.n >= 20 THEN CASE WHEN f = 0 THEN 100 ELSE least(m.n * 100 // (f * 10), 100) END END::INT AS mtld FROM g JOIN m USING (doc_id))"""

SQL: dict[str, str] = {
    "url_parts": "SELECT url, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, lower(regexp_extract(url, '^[a-z]+://[^/?#]*', 0)) AS origin, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), ''), '/') AS target, true AS keeps_origin FROM (SELECT DISTINCT url FROM pages)",
    "url_shapes": f"""WITH p AS (SELECT url, {_PATH} AS path, {_SEGS} AS s, list_filter(string_split(regexp_extract(url, '://[^/]*/(.*)$', 1), '/'), lambda x: x <> '') AS fs FROM (SELECT DISTINCT url FROM pages)),
      q AS (SELECT *, CASE WHEN s[1] IN {_FLOC} THEN s[2:] ELSE s END AS r FROM p), z AS (SELECT *, len(r) = 3 AND r[1] IN ('category', 'services') AND (contains(r[3], '-') OR strlen(r[3]) >= 4) AS ok FROM q)
      SELECT url, CASE WHEN s[1] IN {_LOC} THEN s[1] END AS locale, array_to_string(CASE WHEN len(fs) >= 2 THEN fs[:len(fs) - 1] ELSE fs END, '/') AS family, CASE WHEN len(s) > 0 THEN '/' || array_to_string(s[:2], '/') END AS prefix,
      contains(path, '/cities/') OR contains(path, '/city/') OR (contains(coalesce(s[len(s)], ''), '-') AND strlen(coalesce(s[len(s)], '')) > 4) AS city_shaped, CASE WHEN ok THEN 'category/' || r[2] END AS city_family, CASE WHEN ok THEN r[3] END AS city FROM z""",
    "url_archetypes": "WITH p AS (SELECT url, " + _PATH + " AS path FROM (SELECT DISTINCT url FROM pages)), a AS (" + " UNION ".join(f"SELECT url, '{n}' AS archetype FROM p WHERE contains(path, '{t}')" for t, n in U.ARCHETYPES) + ") SELECT archetype, count(*) AS n_urls FROM a GROUP BY 1",
    "locale_twins": f"""WITH p AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, {_PATH} AS path, {_SEGS} AS s FROM (SELECT DISTINCT url FROM pages)),
      r AS (SELECT host, CASE WHEN s[1] IN {_LOC} THEN s[1] ELSE '' END AS loc, CASE WHEN s[1] IN {_LOC} THEN '/' || ltrim(substr(path, length(s[1]) + 2), '/') ELSE path END AS rest FROM p)
      SELECT host, rest, count(*) AS n_pages, count(DISTINCT loc) AS n_locales FROM r GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT loc) >= 2""",
    "doc_profile": f"""WITH t AS (SELECT doc_id, text, {_TOK} AS t, {_AZ.format('text')} AS low FROM documents WHERE text IS NOT NULL), n AS (SELECT *, len(t) AS n, len(list_distinct(t)) AS u FROM t),
      s AS (SELECT doc_id, n AS n_tokens, u AS n_unique, CASE WHEN n > 0 THEN least((n - u) * 100 // n, 100) END AS repetition,
      CASE WHEN n > 0 THEN least(len(list_filter({_UWORDS.format('text')}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) * 100 // n, 100) END AS entity_density,
      CASE WHEN n > 0 THEN least(len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) * 100 // n, 100) END AS numeric_density,
      CASE WHEN n > 0 THEN least(len(list_filter(t, lambda x: regexp_matches(x, '[0-9]') OR x IN ({_FACTS}))) * 100 // n, 100) END AS fact_density,
      CASE WHEN n > 0 THEN least(len(list_filter(t, lambda x: x IN ({_FUNCTION}))) * 100 // n, 100) END AS function_word_ratio,
      CASE WHEN n > 0 THEN least(len(list_filter(t, lambda x: regexp_matches(x, '[0-9]') OR strlen(x) > 8)) * 100 // n, 100) END AS specificity,
      CASE WHEN text <> '' THEN ({' + '.join("contains(low, '" + p.replace("'", "''") + "')::INT" for p in T.FILLER_PHRASES)}) * 100 // {len(T.FILLER_PHRASES)} END AS filler_phrase_ratio, list_filter(t, lambda x: strlen(x) > 5)[1] AS witness FROM n)
      SELECT *, CASE WHEN function_word_ratio IS NULL THEN 'unmeasured' WHEN function_word_ratio <= 33 THEN 'low' WHEN function_word_ratio <= 66 THEN 'medium' ELSE 'high' END AS genericity_band,
      CASE WHEN specificity IS NULL THEN 'unmeasured' WHEN specificity <= 33 THEN 'low' WHEN specificity <= 66 THEN 'medium' ELSE 'high' END AS specificity_band FROM s""",
    "doc_sentences": f"""WITH l AS (SELECT doc_id, list_transform({_SENT}, lambda s: len({_UWORDS.format('s')})) AS l FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, l, len(l) AS n, coalesce(list_sum(l), 0)::BIGINT AS t, coalesce(list_sum(list_transform(l, lambda x: x * x)), 0)::BIGINT AS q FROM l)
      SELECT doc_id, n AS n_sentences, t // nullif(n, 0) AS avg_sentence_length, CASE WHEN n > 0 THEN len(list_filter(l, lambda x: x > 30)) * 100 // n END AS long_sentence_share,
      CASE WHEN n < 2 THEN 'unmeasured' WHEN n * q - t * t < 8 * n * n THEN 'low' WHEN n * q - t * t < 40 * n * n THEN 'medium' ELSE 'high' END AS sentence_variance FROM n""",
    "doc_lexical": f"""WITH {_LEXICAL} SELECT doc_id, term_entropy, mattr, mtld FROM lex""",
    "doc_levels": f"""WITH {_LEXICAL}, p AS (SELECT * FROM ({{doc_profile}})), n AS (SELECT * FROM ({{doc_sentences}}))
      SELECT p.doc_id, CASE WHEN n_sentences < 2 AND repetition IS NULL THEN 'unmeasured' WHEN coalesce(repetition, 0) <= 20 THEN 'low' WHEN coalesce(repetition, 0) <= 45 THEN 'medium' ELSE 'high' END AS redundancy,
      CASE WHEN term_entropy IS NULL AND repetition IS NULL THEN 'unmeasured' WHEN term_entropy >= 70 THEN 'high' WHEN term_entropy >= 45 AND repetition <= 40 THEN 'medium' ELSE 'low' END AS cohesion, genericity_band, specificity_band, sentence_variance, 'UNMEASURED' AS authorship FROM p JOIN n USING (doc_id) LEFT JOIN lex USING (doc_id)""",
    "intent_sources": " UNION ALL ".join(f"SELECT scope, '{i}' AS intent, a AS answered, {len(ps)} AS questions, a || '/{len(ps)}' AS coverage FROM (SELECT coalesce(source, '(none)') AS scope, " + " + ".join(f"bool_or(contains({_AZ.format('text')}, '{p}'))::INT" for p in ps) + " AS a FROM documents WHERE text IS NOT NULL GROUP BY 1)" for i, ps in T.INTENTS.items()),
    "doc_chunks": f"""WITH d AS (SELECT doc_id, text, {_SENT} AS s FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> ''),
      c AS (SELECT doc_id, i AS chunk_no, s[i * 3 + 1] AS heading, array_to_string(s[i * 3 + 1:i * 3 + 3], ' ') AS text FROM d, LATERAL (SELECT unnest(range((len(s) + 2) // 3)) AS i) UNION ALL SELECT doc_id, 0, 'page', text FROM d WHERE len(s) = 0),
      t AS (SELECT doc_id, chunk_no, heading, text, {_TOK} AS t, {_AZ.format('text')} AS low FROM c), n AS (SELECT *, len(t) AS n FROM t),
      z AS (SELECT doc_id, chunk_no::INT AS chunk_no, n AS n_tokens, CASE WHEN n > 0 THEN len(list_distinct(t)) * 100 // n ELSE 0 END AS cohesion, CASE WHEN len({_UWORDS.format('heading')}) >= 2 AND n >= 8 THEN 80 WHEN n >= 4 THEN 50 ELSE 20 END AS self_contained,
      CASE WHEN contains(text, '?') OR {' OR '.join(f"contains(low, '{c}')" for c in T.ANSWER_CUES)} THEN 80 ELSE least(100, len(list_filter(t, lambda x: regexp_matches(x, '[0-9]') OR x IN ({_FACTS}))) * 100 // greatest(n, 1)) END AS answer_density,
      least(100, len(list_filter(t, lambda x: regexp_matches(x, '[0-9]') OR strlen(x) > 7)) * 100 // greatest(n, 1)) AS specificity FROM n)
      SELECT *, (self_contained + specificity + answer_density) // 3 AS citation_suitability FROM z""",
    "doc_intents": " UNION ALL ".join(f"SELECT doc_id, '{i}' AS intent, a AS answered, {len(ps)} AS questions, a || '/{len(ps)}' AS coverage FROM (SELECT doc_id, " + " + ".join(f"contains({_AZ.format('text')}, '{p}')::INT" for p in ps) + " AS a FROM documents WHERE text IS NOT NULL)" for i, ps in T.INTENTS.items()),
    "exact_duplicates": "SELECT doc_id, class_id, n_copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '') WHERE n_copies > 1",
    "shared_vocabulary": f"""WITH d AS (SELECT doc_id, source AS family, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), k AS (SELECT family, count(*) AS n_texts FROM d GROUP BY 1 HAVING count(*) >= 2),
      t AS (SELECT family, unnest(list_distinct({_TOK})) AS t FROM d), w AS (SELECT family, t, count(*) AS c FROM t GROUP BY 1, 2) SELECT family, n_texts, count(*) AS n_tokens, count(*) FILTER (c = n_texts) AS n_shared FROM w JOIN k USING (family) GROUP BY 1, 2""",
    "obs_url_metrics": f"WITH {_CUR} SELECT url, sum(clicks) FILTER (kind = 'search_performance')::BIGINT AS gsc_clicks, sum(impressions) FILTER (kind = 'search_performance')::BIGINT AS gsc_impressions, nullif(count(*) FILTER (kind = 'ai_citation'), 0) AS citations FROM cur WHERE url IS NOT NULL GROUP BY url",
    "obs_demand_axes": f"""WITH {_CUR}, g AS (SELECT page_url, sum(impressions) AS i, min(position) FILTER (position > 0)::DOUBLE AS b FROM cur WHERE kind = 'search_performance' AND url IS NOT NULL GROUP BY 1)
      SELECT page_url, CASE WHEN i > 0 OR b IS NOT NULL THEN least(i // 10, 100)::INT END AS demand, CASE WHEN i > 0 OR b IS NOT NULL THEN CASE WHEN b > 10 THEN round(least((b - 10) * 5, 100))::INT ELSE 0 END END AS visibility_gap FROM g""",
    "obs_ctr_gap": f"""WITH {_CUR}, r AS (SELECT *, {_CTR} AS ctr FROM cur WHERE kind = 'search_performance' AND bucket = 'current' AND impressions >= 50 AND position IS NOT NULL), z AS (SELECT *, greatest(round(impressions * ctr)::BIGINT - clicks, 0) AS recoverable FROM r)
      SELECT row_id, coalesce(query, url) AS subject, url, clicks, impressions, round(ctr * 100)::INT AS expected_ctr_pct, recoverable, (recoverable * 50 * 55 // 50)::BIGINT AS expected_value FROM z WHERE recoverable >= 5""",
    "obs_striking_distance": f"WITH {_CUR}, {_PAGES} SELECT row_id, coalesce(query, '(unspecified query)') AS query, url, impressions, clicks FROM cur WHERE kind = 'search_performance' AND bucket = 'current' AND impressions >= 50 AND position >= 4 AND position < 20 AND page_url IN (SELECT page_url FROM measured)",
    "obs_decay": f"""WITH {_CUR}, g AS (SELECT url, sum(clicks) FILTER (bucket = 'previous')::BIGINT AS clicks_before, coalesce(sum(clicks) FILTER (bucket = 'current'), 0)::BIGINT AS clicks_after FROM cur WHERE kind = 'search_performance' AND url IS NOT NULL GROUP BY url)
      SELECT url, clicks_before, clicks_after, trunc((clicks_after - clicks_before) * 100 / clicks_before)::BIGINT AS delta_pct FROM g WHERE clicks_before >= 10 AND greatest(clicks_before - clicks_after, 0) * 100 // clicks_before >= 30""",
    "obs_cannibalization": f"""WITH {_CUR}, f AS (SELECT *, row_number() OVER (PARTITION BY query, page_url ORDER BY row_id) AS k FROM cur WHERE kind = 'search_performance' AND bucket = 'current' AND impressions >= 50 AND strlen(query) > 3 AND url IS NOT NULL),
      s AS (SELECT query, page_url, clicks, list_filter(string_split(regexp_extract(url, '://[^/]*/(.*)$', 1), '/'), lambda x: x <> '') AS fs FROM f WHERE k = 1), z AS (SELECT query, page_url, clicks, array_to_string(CASE WHEN len(fs) >= 2 THEN fs[:len(fs) - 1] ELSE fs END, '/') AS fam FROM s)
      SELECT z.query, page_url, n_urls, g.clicks, action FROM z JOIN (SELECT query, count(*) AS n_urls, sum(clicks)::BIGINT AS clicks, CASE WHEN count(DISTINCT fam) = 1 THEN 'CONSOLIDATE' ELSE 'DIFFERENTIATE' END AS action FROM z GROUP BY query HAVING count(*) >= 2 AND sum(clicks) >= 10) g USING (query)""",
    "obs_demand_without_page": f"WITH {_CUR}, {_PAGES} SELECT row_id, url, impressions FROM cur WHERE kind = 'search_performance' AND impressions >= 50 AND url IS NOT NULL AND page_url NOT IN (SELECT page_url FROM measured)",
    "obs_demand_without_bots": f"WITH {_CUR}, {_PAGES} SELECT row_id, url, c.impressions FROM cur c JOIN sums s USING (page_url) WHERE kind = 'search_performance' AND c.impressions >= 50 AND s.hits = 0 AND page_url IN (SELECT page_url FROM measured)",
    "obs_bot_findings": f"""WITH {_CUR}, {_PAGES}, facts AS (SELECT regexp_replace(url, '/+$', '') AS page_url, bool_or(indexable <> 'indexable') AS closed, bool_or(indexable = 'indexable' AND inbound = 0 AND NOT regexp_matches(url, '^[^:]+://[^/?#]*/?$')) AS orphan FROM pg GROUP BY 1),
      b AS (SELECT c.row_id, c.url, c.hits, c.status, f.closed, f.orphan, s.impressions AS si FROM cur c LEFT JOIN facts f USING (page_url) LEFT JOIN sums s USING (page_url) WHERE kind = 'bot_crawl' AND c.hits > 0 AND c.url IS NOT NULL)
      SELECT row_id, url, hits, 'SE-OBS-007' AS code FROM b WHERE status >= 400 UNION ALL SELECT row_id, url, hits, 'SE-OBS-008' FROM b WHERE closed UNION ALL SELECT row_id, url, hits, 'SE-OBS-009' FROM b WHERE hits >= 20 AND si = 0 AND closed IS NOT NULL UNION ALL SELECT row_id, url, hits, 'SE-OBS-010' FROM b WHERE orphan""",
    "obs_ai_funnel": f"""WITH {_CUR}, g AS (SELECT url, sum(CASE WHEN kind = 'bot_crawl' AND bot_role = 'search_discovery' THEN greatest(hits, 1) ELSE 0 END) AS d, sum(CASE WHEN kind = 'bot_crawl' AND bot_role = 'citation_fetch' THEN greatest(hits, 1) WHEN kind = 'ai_citation' THEN 1 ELSE 0 END) AS c,
      sum(CASE WHEN kind = 'ai_referral' THEN greatest(hits, clicks, 1) ELSE 0 END) AS r FROM cur WHERE url IS NOT NULL GROUP BY url)
      SELECT url, nullif(d, 0)::BIGINT AS discovery_hits, nullif(c, 0)::BIGINT AS citation_hits, nullif(r, 0)::BIGINT AS referrals, CASE WHEN d > 0 THEN least(c * 100 // d, 100)::INT END AS citation_rate, CASE WHEN c > 0 THEN least(r * 100 // c, 100)::INT END AS click_through, d >= 5 AND c = 0 AS uncited FROM g WHERE d > 0 OR c > 0 OR r > 0""",
    "obs_outcomes": f"""WITH {_CUR}, g AS (SELECT count(*) FILTER (kind = 'ai_citation') AS n, count(DISTINCT query) FILTER (kind = 'ai_citation') AS q, count(DISTINCT url) FILTER (kind = 'ai_citation') AS u, sum(clicks) FILTER (kind = 'search_performance')::BIGINT AS k, sum(impressions) FILTER (kind = 'search_performance')::BIGINT AS i FROM cur)
      SELECT unnest(['citation_rate', 'mention_rate', 'prompts_observed', 'cited_urls', 'share_of_voice', 'search_clicks']) AS name, unnest([n, n, q, u, NULL, k]) AS value, unnest([n, n, q, u, n, k]) AS numerator, unnest([NULL, NULL, NULL, NULL, NULL, i]) AS denominator FROM g""",
    "obs_citation_drops": f"""WITH {_CUR}, c AS (SELECT DISTINCT query, url, bucket FROM cur WHERE kind = 'ai_citation' AND query IS NOT NULL AND url IS NOT NULL)
      SELECT query, url FROM c b WHERE bucket = 'previous' AND NOT EXISTS (SELECT 1 FROM c n WHERE n.bucket = 'current' AND n.query = b.query AND n.url = b.url) AND EXISTS (SELECT 1 FROM c n WHERE n.bucket = 'current' AND n.query = b.query)""",
    "obs_kinds": f"WITH {_CUR} SELECT provider, kind, count(*) AS n_rows, {_KIND_CASE} AS implied_kind FROM cur GROUP BY ALL",
    "agent_tokens": f"""WITH {_CUR}, u AS (SELECT user_agent, count(*) AS n FROM cur WHERE user_agent IS NOT NULL GROUP BY 1), m AS (SELECT user_agent, n, {_AZ.format('user_agent')} AS low, (SELECT arg_max(token, (length(token), token)) FROM ai_agents a WHERE contains({_AZ.format('user_agent')}, a.token)) AS t FROM u),
      z AS (SELECT n, coalesce(t, CASE WHEN contains(low, 'bot') OR contains(low, 'spider') OR contains(low, 'crawler') THEN 'unknown-bot' END) AS token FROM m) SELECT token, sum(n)::BIGINT AS n_rows FROM z WHERE token IS NOT NULL GROUP BY token""",
}
SQL["doc_levels"] = SQL["doc_levels"].replace("{doc_profile}", SQL["doc_profile"]).replace("{doc_sentences}", SQL["doc_sentences"])
