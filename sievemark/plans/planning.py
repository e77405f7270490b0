"""Queries over families, opportunities, plans, streams and robots files, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import observations as O
from ..operators import planning as P
from ..operators.common import shared_folder, table
from ..sources.imports import listed_agents, log_hits, observations_of
from ..streaming import events as E
from .evidence import _CUR, _rows
from .history import _REFS, _refs


def _latest(s: SparkSession, d: str) -> DataFrame:
    last = _refs(s, d).select(F.col("latest").alias("snapshot_id"))
    p = table(s, d, "pages").join(last, "snapshot_id", "left_semi")
    cols = ["status", "indexable", "content_hash", "title", "family", "inbound", "gsc_clicks", "gsc_impressions"]
    return p.groupBy("url").agg(*[F.max(c).alias(c) for c in cols])


def family_matrix(s: SparkSession, d: str) -> DataFrame:
    """Matrix and verdict of every route family."""
    return P.family_matrix(_latest(s, d))


def _items(s: SparkSession, d: str) -> DataFrame:
    pages = _latest(s, d)
    return P.opportunities(pages, P.family_matrix(pages), O.demand_axes(_rows(s, d)))


def opportunity_rank(s: SparkSession, d: str) -> DataFrame:
    """Opportunities in their order of trust and demand."""
    return P.rank_opportunities(_items(s, d)).select("kind", "subject", "trust", "rank", "demand", "visibility_gap")


def opportunity_plan(s: SparkSession, d: str) -> DataFrame:
    """Steps of every opportunity."""
    return P.plan_stages(_items(s, d))


def imported_observations(s: SparkSession, d: str) -> DataFrame:
    """Observations in the import files per kind and provider, as delivered."""
    rows = observations_of(table(s, d, "import_files"), listed_agents(table(s, d, "ai_agents")))
    return rows.groupBy("kind", "provider", "bot_role").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in ("clicks", "impressions", "hits", "volume")], F.countDistinct("url").alias("n_urls"), F.count("referer").alias("n_referers"), F.max("difficulty").alias("difficulty"))


def imported_log_hits(s: SparkSession, d: str) -> DataFrame:
    """Bot hits of the access-log lines in the import files."""
    return log_hits(table(s, d, "import_files"), table(s, d, "ai_agents"))


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Sliding windows over the event stream, run to its end; the batch SQL must agree."""
    at = f"{shared_folder(s)}/w{uuid.uuid4().hex}"
    E.keep_result(E.windowed_counts(E.read_events(s, f"{d}/events.parque[t]")), f"{at}/result", f"{at}/progress").awaitTermination()
    return s.read.parquet(f"{at}/result").select(F.date_format("started", "yyyy-MM-dd").alias("started"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of the event stream, run to its end; a session ends six hours after its last event."""
    at = f"{shared_folder(s)}/s{uuid.uuid4().hex}"
    E.keep_result(E.sessions(E.read_events(s, f"{d}/events.parque[t]")), f"{at}/result", f"{at}/progress").awaitTermination()
    return s.read.parquet(f"{at}/result").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (family_matrix, opportunity_rank, opportunity_plan, imported_observations, imported_log_hits, stream_windows, stream_sessions)}

_PG = f"""{_REFS}, lp AS (SELECT url, struct_pack(status := max(status), indexable := max(indexable), content_hash := max(content_hash), title := max(title), family := max(family), inbound := max(inbound), c := max(gsc_clicks), i := max(gsc_impressions)) AS m FROM pages WHERE snapshot_id IN (SELECT latest FROM refs) GROUP BY url),
fm AS (SELECT m.family AS family, count(*) AS n_pages, count(*) FILTER (m.indexable = 'indexable') AS n_indexable, count(DISTINCT CASE WHEN m.indexable = 'indexable' THEN regexp_replace(lower(trim(m.content_hash)), '^(?:[a-z0-9-]+:|0x)', '') END) AS n_unique, count(*) FILTER (m.inbound = 0) AS n_unlinked, sum(m.c)::BIGINT AS clicks, sum(m.i)::BIGINT AS impressions FROM lp WHERE m.status = 200 AND m.family IS NOT NULL GROUP BY 1)"""
_VERDICT = "CASE WHEN n_indexable = 0 THEN 'NOINDEX_BY_DEFAULT' WHEN n_indexable >= 2 AND n_unique = 1 THEN 'CONSOLIDATE' WHEN n_unique >= 2 AND n_unlinked < n_pages THEN 'SAFE_IF_REQUIREMENTS_MET' WHEN n_unlinked = n_pages THEN 'REVIEW' WHEN n_unique = 1 THEN 'SAFE_IF_REQUIREMENTS_MET' ELSE 'UNMEASURED' END"
_ITEMS = f"""{_PG}, {_CUR}, ax AS (SELECT page_url, CASE WHEN i > 0 OR b IS NOT NULL THEN least(i // 10, 100)::INT END AS demand, CASE WHEN i > 0 OR b IS NOT NULL THEN CASE WHEN b > 10 THEN round(least((b - 10) * 5, 100))::INT ELSE 0 END END AS visibility_gap
  FROM (SELECT page_url, sum(impressions) AS i, min(position) FILTER (position > 0)::DOUBLE AS b FROM cur WHERE kind = 'search_performance' AND url IS NOT NULL GROUP BY 1)),
  it AS (SELECT 'link_gap' AS kind, url AS subject, 60 AS confidence, 10 AS risk, 20 AS cost FROM lp WHERE m.status = 200 AND m.indexable = 'indexable' AND m.inbound = 0 AND NOT regexp_matches(url, '^[^:]+://[^/?#]*/?$')
  UNION ALL SELECT 'content_gap', url, 50, NULL, 40 FROM lp WHERE m.status = 200 AND m.indexable = 'indexable' AND m.title IS NULL
  UNION ALL SELECT CASE v WHEN 'CONSOLIDATE' THEN 'cannibal' WHEN 'NOINDEX_BY_DEFAULT' THEN 'noindex' ELSE 'create_family' END, family, NULL, CASE v WHEN 'CONSOLIDATE' THEN 40 WHEN 'NOINDEX_BY_DEFAULT' THEN 80 ELSE 30 END, 60 FROM (SELECT family, {_VERDICT} AS v FROM fm) WHERE v IN ('CONSOLIDATE', 'NOINDEX_BY_DEFAULT', 'SAFE_IF_REQUIREMENTS_MET')),
  tr AS (SELECT it.*, demand, visibility_gap, CASE WHEN confidence >= 40 AND risk <= 70 THEN 3 WHEN confidence >= 40 AND risk IS NULL THEN 2 WHEN confidence IS NULL AND risk <= 70 THEN 2 WHEN confidence IS NULL AND risk IS NULL THEN 1 ELSE 0 END AS trust FROM it LEFT JOIN ax ON ax.page_url = rtrim(it.subject, '/'))"""
_KIND_OF = "CASE " + " ".join(f"WHEN replace(lower({{0}}), '-', '_') = '{k}' THEN '{v}'" for k, v in O.KINDS.items()) + " END"
_IMPLIED = "CASE " + " ".join(f"WHEN provider IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in O.PROVIDER_KINDS.items()) + " ELSE 'analytics' END"
_AGENT = "CASE WHEN ua IS NULL THEN NULL WHEN contains(ua, 'googlebot') AND NOT contains(ua, 'google-extended') THEN 'search_discovery' WHEN contains(ua, 'bingbot') THEN 'search_discovery' ELSE coalesce((SELECT arg_max(role, (length(token), token)) FROM ai_agents a WHERE contains(ua, a.token)), CASE WHEN contains(ua, 'bot') OR contains(ua, 'spider') OR contains(ua, 'crawler') THEN 'other' END) END"
_IMPORTED = " UNION ALL ".join(f"SELECT provider AS fp, kind AS fk, '{b}' AS branch, unnest({b}) AS r FROM import_files" for b in ("rows", "keywords", "serp", "backlinks"))
SQL: dict[str, str] = {
    "imported_observations": f"""WITH e AS (SELECT * FROM ({_IMPORTED}) WHERE r IS NOT NULL), p AS (SELECT *, lower(coalesce(r.provider, fp, 'gsc')) AS provider, translate(r.user_agent, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ua FROM e), b AS (SELECT *, CASE WHEN branch = 'rows' THEN {_AGENT} END AS bot_role FROM p),
      t AS (SELECT *, coalesce({_KIND_OF.format('r.kind')}, CASE branch WHEN 'rows' THEN coalesce({_KIND_OF.format('fk')}, {_IMPLIED}) WHEN 'keywords' THEN 'keyword_volume' WHEN 'serp' THEN 'serp_position' ELSE 'backlink' END) AS told FROM b), k AS (SELECT *, CASE WHEN told = 'analytics' AND bot_role IS NOT NULL THEN 'bot_crawl' ELSE told END AS kind FROM t),
      o AS (SELECT kind, provider, bot_role, coalesce(r.clicks, 0) AS clicks, CASE WHEN kind = 'search_performance' THEN coalesce(r.impressions, 0) ELSE 0 END AS impressions, CASE WHEN kind IN ('search_performance', 'keyword_volume') THEN 0 WHEN kind = 'backlink' THEN greatest(coalesce(r.backlinks, 0), coalesce(r.hits, 0), coalesce(r.impressions, 0), 1) ELSE greatest(coalesce(r.hits, 0), coalesce(r.impressions, 0)) END AS hits,
        CASE WHEN kind = 'keyword_volume' THEN greatest(coalesce(r.volume, 0), coalesce(r.search_volume, 0), coalesce(r.impressions, 0)) ELSE 0 END AS volume, r.url AS url, coalesce(r.referer, r.source_url) AS referer, coalesce(r.difficulty, r.keyword_difficulty) AS difficulty FROM k),
      q AS (SELECT lower(coalesce(provider, 'gsc')) AS provider, unnest(prompts) AS p FROM import_files), u AS (SELECT provider, p, list_filter(coalesce(p.cited_urls, []), lambda x: x IS NOT NULL) AS c FROM q WHERE p IS NOT NULL),
      z AS (SELECT 'ai_citation' AS kind, provider, unnest(c) AS url, 1 AS hits FROM u UNION ALL SELECT 'ai_prompt', provider, 'prompt:' || coalesce(p.platform, ''), 0 FROM u WHERE len(c) = 0),
      a AS (SELECT * FROM o UNION ALL SELECT kind, provider, NULL, 0, 0, hits, 0, url, NULL, NULL FROM z)
      SELECT kind, provider, bot_role, count(*) AS n_rows, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, sum(hits)::BIGINT AS hits, sum(volume)::BIGINT AS volume, count(DISTINCT url) AS n_urls, count(referer) AS n_referers, max(difficulty) AS difficulty FROM a GROUP BY 1, 2, 3""",
    "opportunity_rank": f"WITH {_ITEMS} SELECT kind, subject, trust, row_number() OVER (ORDER BY trust DESC, demand IS NOT NULL DESC, coalesce(demand, 0) DESC, coalesce(visibility_gap, 0) DESC, least(coalesce(cost, 0), 100), kind, subject) AS rank, demand, visibility_gap FROM tr",
    "family_matrix": f"WITH {_PG} SELECT *, {_VERDICT} AS verdict FROM fm",
    "opportunity_plan": f"""WITH {_PG}, o AS (SELECT 'link_gap' AS kind, url AS subject, 'LINK' AS action FROM lp WHERE m.status = 200 AND m.indexable = 'indexable' AND m.inbound = 0 AND NOT regexp_matches(url, '^[^:]+://[^/?#]*/?$')
      UNION SELECT 'content_gap', url, 'IMPROVE' FROM lp WHERE m.status = 200 AND m.indexable = 'indexable' AND m.title IS NULL
      UNION SELECT CASE v WHEN 'CONSOLIDATE' THEN 'cannibal' WHEN 'NOINDEX_BY_DEFAULT' THEN 'noindex' ELSE 'create_family' END, family, CASE v WHEN 'CONSOLIDATE' THEN 'CONSOLIDATE' WHEN 'NOINDEX_BY_DEFAULT' THEN 'NOINDEX' ELSE 'CREATE' END FROM (SELECT family, {_VERDICT} AS v FROM fm) WHERE v IN ('CONSOLIDATE', 'NOINDEX_BY_DEFAULT', 'SAFE_IF_REQUIREMENTS_MET')),
      s AS (SELECT *, CASE action WHEN 'CREATE' THEN ['ADD_FACT', 'BIND_ENTITY', 'ADD_SCHEMA', 'CRAWL', 'OBSERVE_GSC'] WHEN 'CONSOLIDATE' THEN ['PICK_CANONICAL', 'CRAWL', 'DIFF'] WHEN 'NOINDEX' THEN ['SET_NOINDEX', 'CRAWL'] WHEN 'LINK' THEN ['ADD_INTERNAL_LINKS', 'CRAWL'] ELSE ['UPDATE_CONTENT', 'CRAWL', 'DIFF', 'OBSERVE_GSC'] END AS s FROM o)
      SELECT kind, subject, action, i::INT AS stage_no, s[i + 1] AS stage, CASE WHEN i > 0 THEN s[i] END AS requires, CASE WHEN i > 0 THEN CASE WHEN s[i + 1] IN ('CRAWL', 'OBSERVE_GSC', 'DIFF') THEN 'VERIFY_AFTER' ELSE 'REQUIRES' END END AS relation FROM s, LATERAL (SELECT unnest(range(len(s))) AS i)""",
    "stream_sessions": "SELECT user_id, sum(fresh)::BIGINT AS n_sessions, count(*) AS n_events FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) GROUP BY 1",
    "stream_windows": "WITH w AS (SELECT event_type, value, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS started FROM events) SELECT strftime(started, '%Y-%m-%d') AS started, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2",
    "imported_log_hits": """WITH l AS (SELECT origin, unnest(list_concat(coalesce(lines, []), coalesce(string_split_regex(log, '\\r?\\n'), []))) AS line FROM import_files), p AS (SELECT origin, regexp_extract(line, '^(\\S+) \\S+ \\S+ \\[[^\\]]*\\] "(?:[A-Z]+ )?(\\S+)[^"]*" ([0-9]{3}) .*', ['ip', 'path', 'status']) AS m,
      translate(regexp_extract(line, '"([^"]*)"\\s*$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ua FROM l WHERE NOT starts_with(line, '#')),
      r AS (SELECT CASE WHEN regexp_matches(m.path, '^https?://') THEN m.path ELSE rtrim(origin, '/') || CASE WHEN starts_with(m.path, '/') THEN '' ELSE '/' END || m.path END AS url, m.status::VARCHAR AS status,
      coalesce((SELECT arg_max(role, (length(token), token)) FROM ai_agents a WHERE contains(p.ua, a.token)), CASE WHEN contains(ua, 'bot') OR contains(ua, 'spider') OR contains(ua, 'crawler') THEN 'other' END) AS bot_role FROM p WHERE m.path <> '')
      SELECT url, bot_role, status::INT AS status, count(*) AS hits, 'bot_crawl' AS kind FROM r WHERE bot_role IS NOT NULL GROUP BY ALL""",
}
