"""Queries over snapshots of runs, pages and findings, the query language, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..operators import history as H
from ..operators.common import table
from . import dsl
from .evidence import _PAGES, _pages
from .graphs import fnv_sql


def _refs(s: SparkSession, d: str) -> DataFrame:
    return H.reference_runs(H.filled_runs(table(s, d, "runs"), table(s, d, "pages")))


def run_asof(s: SparkSession, d: str) -> DataFrame:
    """Latest, previous and 28-day run of each site, and the change of errors."""
    return _refs(s, d).select("site", "latest", "previous", "window_run", (F.col("errors") - F.col("previous_errors")).alias("errors_delta"), (F.col("revision") != F.col("previous_revision")).alias("source_revision_changed"))


def page_history(s: SparkSession, d: str) -> DataFrame:
    """Clicks, citations and producer changes of each site's latest pages."""
    return H.page_history(table(s, d, "pages"), _refs(s, d))


def gate_verdict(s: SparkSession, d: str) -> DataFrame:
    """Gate verdict per site."""
    return H.gate(table(s, d, "findings"), table(s, d, "pages"), _refs(s, d))


def axis_scores(s: SparkSession, d: str) -> DataFrame:
    """All axes with the distinct findings of the latest snapshots."""
    last = _refs(s, d).select(F.col("latest").alias("snapshot_id"))
    level = F.when(F.col("severity") == "warning", "warn").when(F.col("severity") == "notice", "info").otherwise(F.col("severity"))
    f = table(s, d, "findings").join(last, "snapshot_id", "left_semi").select("snapshot_id", "fingerprint", level.alias("severity"), F.regexp_extract("code", "^([A-Z0-9]+)-", 1).alias("family")).distinct()
    return H.axis_scores(f, rendered=False)


def inventory_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts over the latest pages."""
    p = _pages(s, d)
    return p.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("status").between(200, 399)).alias("n_fetched"), F.count_if(F.col("status") >= 400).alias("n_errors"), F.count_if(F.col("indexable") == "indexable").alias("n_indexable"), F.count_if(F.col("inbound") == 0).alias("n_unlinked"))


def duplicate_titles(s: SparkSession, d: str) -> DataFrame:
    """Indexable pages of a latest snapshot whose title others share, as class and size."""
    last = _refs(s, d).select(F.col("latest").alias("snapshot_id"))
    p = table(s, d, "pages").join(last, "snapshot_id", "left_semi").where("status = 200 AND indexable = 'indexable' AND trim(title) <> ''").select("snapshot_id", "url", "title").distinct()
    g = p.groupBy("snapshot_id", "title").agg(F.min("url").alias("class_url"), F.count(F.lit(1)).alias("n_urls")).where("n_urls > 1")
    return p.join(g, ["snapshot_id", "title"]).select("snapshot_id", "url", "title", "class_url", "n_urls")


def duplicate_content(s: SparkSession, d: str) -> DataFrame:
    """Indexable pages of a latest snapshot with equal content, as class and size."""
    from ..operators.snapshots import plain_hash

    last = _refs(s, d).select(F.col("latest").alias("snapshot_id"))
    p = table(s, d, "pages").join(last, "snapshot_id", "left_semi").where("status = 200 AND indexable = 'indexable'").select("snapshot_id", "url", plain_hash(F.col("content_hash")).alias("h")).where("h IS NOT NULL").distinct()
    g = p.groupBy("snapshot_id", "h").agg(F.min("url").alias("class_url"), F.count(F.lit(1)).alias("n_urls")).where("n_urls > 1")
    return p.join(g, ["snapshot_id", "h"]).select("snapshot_id", "url", "class_url", "n_urls")


def finding_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Own fingerprints of all findings' codes and URLs: code and the short 128-bit hash."""
    return table(s, d, "findings").where("url IS NOT NULL").select("code", "url").distinct().select("code", "url", fingerprint(F.concat(F.lit("SE-"), F.col("code")), F.col("url")).alias("own_fingerprint"))


def _collections(s: SparkSession, d: str) -> dict[str, DataFrame]:
    last = _refs(s, d).select(F.col("latest").alias("snapshot_id"))
    runs = table(s, d, "runs").select("snapshot_id", "run_id", "site", "mode", "recorded_at", "errors").distinct()
    found = table(s, d, "findings").join(last, "snapshot_id", "left_semi").select("code", "fingerprint", "severity", "summary", "url").distinct()
    return {"urls": _pages(s, d), "findings": found, "runs": runs}


def _dsl(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        return dsl.run(text, _collections(s, d))

    query.__doc__ = text
    return query


DSL = {
    "dsl_unlinked": "FROM urls WHERE inbound = 0 AND indexable = Indexable RETURN url, inbound LIMIT 20",
    "dsl_errors": 'FROM findings WHERE severity = "error" AND summary contains "PAGE" RETURN url, code, nothing',
    "dsl_not_equal": "from findings where severity != ERROR and code contains meta limit 500",
    "dsl_numbers": "FROM runs WHERE errors >= 3 AND mode = live RETURN snapshot_id, errors LIMIT 200",
    "dsl_missing_field": "FROM urls WHERE authority != 1",
    "dsl_status": "FROM urls WHERE status < 300 AND url contains /services/ RETURN url, status LIMIT 30",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (run_asof, page_history, gate_verdict, axis_scores, inventory_counts, duplicate_titles, duplicate_content, finding_fingerprints)} | {k: _dsl(v) for k, v in DSL.items()}

_REFS = """fr AS (SELECT rtrim(site, '/') AS site, snapshot_id, min(recorded_at) AS recorded_at, max(repo_revision) AS repo_revision, max(mode) AS mode, max(errors) AS errors FROM runs WHERE snapshot_id IN (SELECT snapshot_id FROM pages) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY recorded_at DESC, snapshot_id DESC) AS k, max(recorded_at) OVER (PARTITION BY site) AS last FROM fr),
wk AS (SELECT site, snapshot_id, row_number() OVER (PARTITION BY site ORDER BY abs(recorded_at - (last - 2419200)), snapshot_id DESC) AS w FROM rk WHERE k > 1 AND abs(recorded_at - (last - 2419200)) <= 864000),
refs AS (SELECT l.site, l.snapshot_id AS latest, p.snapshot_id AS previous, w.snapshot_id AS window_run, l.errors, p.errors AS previous_errors, l.repo_revision AS revision, p.repo_revision AS previous_revision, l.mode, p.mode AS previous_mode
  FROM rk l LEFT JOIN rk p ON l.site = p.site AND p.k = 2 LEFT JOIN wk w ON l.site = w.site AND w.w = 1 WHERE l.k = 1),
one AS (SELECT snapshot_id, url, max(gsc_clicks) AS gsc_clicks, max(producer_hash) AS producer_hash, max(citations) AS citations FROM pages GROUP BY 1, 2)"""
_FOUND = f"WITH {_REFS}, f AS (SELECT DISTINCT code, fingerprint, severity, summary, url FROM findings WHERE snapshot_id IN (SELECT latest FROM refs))"
_DELTA = "CASE WHEN {b} <> 0 THEN trunc(({a} - {b}) * 100 / {b})::BIGINT END"

SQL: dict[str, str] = {
    "finding_fingerprints": "SELECT code, url, 'SE-' || code || ':' || lower(lpad(to_hex((" + fnv_sql("url") + ").d), 8, '0')) AS own_fingerprint FROM (SELECT DISTINCT code, url FROM findings WHERE url IS NOT NULL AND code IS NOT NULL AND url <> '')",
    "run_asof": f"WITH {_REFS} SELECT site, latest, previous, window_run, errors - previous_errors AS errors_delta, revision <> previous_revision AS source_revision_changed FROM refs",
    "page_history": f"""WITH {_REFS} SELECT r.site, n.url, n.gsc_clicks AS clicks, {_DELTA.format(a='n.gsc_clicks', b='b.gsc_clicks')} AS clicks_delta, {_DELTA.format(a='n.gsc_clicks', b='w.gsc_clicks')} AS clicks_delta_28d, n.producer_hash <> b.producer_hash AS producer_changed, n.citations
      FROM refs r JOIN one n ON n.snapshot_id = r.latest LEFT JOIN one b ON b.snapshot_id = r.previous AND b.url = n.url LEFT JOIN one w ON w.snapshot_id = r.window_run AND w.url = n.url""",
    "gate_verdict": f"""WITH {_REFS}, e AS (SELECT DISTINCT snapshot_id, fingerprint, min(url) OVER (PARTITION BY snapshot_id, fingerprint) AS url FROM findings WHERE severity = 'error'),
      h AS (SELECT r.site, e.fingerprint, e.url FROM refs r JOIN e ON e.snapshot_id = r.latest), b AS (SELECT r.site, e.fingerprint, e.url FROM refs r JOIN e ON e.snapshot_id = r.previous),
      m AS (SELECT coalesce(h.site, b.site) AS site, h.site IS NOT NULL AS ih, b.site IS NOT NULL AS ib, least(h.url, b.url) AS url FROM h FULL JOIN b ON h.site = b.site AND h.fingerprint = b.fingerprint),
      z AS (SELECT m.*, EXISTS (SELECT 1 FROM pages p JOIN refs r ON p.snapshot_id = r.latest WHERE r.site = m.site AND p.url = m.url) AS measured FROM m),
      c AS (SELECT site, count(*) FILTER (ih) AS n_errors, count(*) FILTER (ih AND NOT ib) AS n_new, count(*) FILTER (NOT ih AND measured) AS n_resolved, count(*) FILTER (NOT ih AND NOT measured) AS n_lost FROM z GROUP BY 1),
      j AS (SELECT r.*, coalesce(n_errors, 0) AS n_errors, coalesce(n_new, 0) AS n_new, coalesce(n_resolved, 0) AS n_resolved, coalesce(n_lost, 0) AS n_lost FROM refs r LEFT JOIN c USING (site))
      SELECT site, CASE WHEN previous IS NULL AND n_errors > 0 THEN 1 WHEN previous IS NULL THEN 0 WHEN mode <> previous_mode THEN 11 WHEN n_new > 0 OR n_lost > 0 THEN 10 ELSE 0 END AS code, n_errors,
      CASE WHEN previous IS NOT NULL THEN n_new END AS n_new, CASE WHEN previous IS NOT NULL THEN n_resolved END AS n_resolved, CASE WHEN previous IS NOT NULL THEN n_lost END AS n_lost FROM j""",
    "axis_scores": f"""WITH {_REFS}, f AS (SELECT DISTINCT snapshot_id, fingerprint, severity, regexp_extract(code, '^([A-Z0-9]+)-', 1) AS family FROM findings WHERE snapshot_id IN (SELECT latest FROM refs)), n AS (SELECT family, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'notice') AS i FROM f GROUP BY 1),
      a(axis, family) AS (VALUES {", ".join(f"('{a}', '{f}')" for a, f in H.AXES.items())}) SELECT axis, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(i, 0) AS infos, axis = 'render_reconciliation' AS unmeasured FROM a LEFT JOIN n USING (family)""",
    "inventory_counts": "WITH cur AS (SELECT NULL AS page_url, NULL AS url, NULL AS kind, 0 AS hits, 0 AS impressions), " + _PAGES + " SELECT count(*) AS n_pages, count(*) FILTER (status BETWEEN 200 AND 399) AS n_fetched, count(*) FILTER (status >= 400) AS n_errors, count(*) FILTER (indexable = 'indexable') AS n_indexable, count(*) FILTER (inbound = 0) AS n_unlinked FROM pg",
    "duplicate_titles": f"WITH {_REFS}, p AS (SELECT DISTINCT snapshot_id, url, title FROM pages WHERE snapshot_id IN (SELECT latest FROM refs) AND status = 200 AND indexable = 'indexable' AND trim(title) <> '') SELECT snapshot_id, url, title, class_url, n_urls FROM (SELECT *, min(url) OVER w AS class_url, count(*) OVER w AS n_urls FROM p WINDOW w AS (PARTITION BY snapshot_id, title)) WHERE n_urls > 1",
    "duplicate_content": f"WITH {_REFS}, p AS (SELECT DISTINCT snapshot_id, url, regexp_replace(lower(trim(content_hash)), '^(?:[a-z0-9-]+:|0x)', '') AS h FROM pages WHERE snapshot_id IN (SELECT latest FROM refs) AND status = 200 AND indexable = 'indexable' AND content_hash IS NOT NULL) SELECT snapshot_id, url, class_url, n_urls FROM (SELECT snapshot_id, url, min(url) OVER w AS class_url, count(*) OVER w AS n_urls FROM p WINDOW w AS (PARTITION BY snapshot_id, h)) WHERE n_urls > 1",
    "dsl_unlinked": "WITH cur AS (SELECT NULL AS page_url, NULL AS url, NULL AS kind, 0 AS hits, 0 AS impressions), " + _PAGES + " SELECT url, inbound FROM pg WHERE inbound = 0 AND lower(indexable) = 'indexable' ORDER BY inbound, indexable, status, url LIMIT 20",
    "dsl_errors": f"{_FOUND} SELECT code, url FROM f WHERE severity = 'error' AND contains(lower(summary), 'page') ORDER BY code, fingerprint, severity, summary, url LIMIT 50",
    "dsl_not_equal": f"{_FOUND} SELECT * FROM f WHERE lower(severity) <> 'error' AND contains(lower(code), 'meta') ORDER BY code, fingerprint, severity, summary, url LIMIT 200",
    "dsl_numbers": "SELECT errors, snapshot_id FROM (SELECT DISTINCT snapshot_id, run_id, site, mode, recorded_at, errors FROM runs) WHERE errors >= 3 AND mode = 'live' ORDER BY errors, mode, recorded_at, run_id, site, snapshot_id LIMIT 200",
    "dsl_missing_field": "WITH cur AS (SELECT NULL AS page_url, NULL AS url, NULL AS kind, 0 AS hits, 0 AS impressions), " + _PAGES + " SELECT * FROM pg WHERE false",
    "dsl_status": "WITH cur AS (SELECT NULL AS page_url, NULL AS url, NULL AS kind, 0 AS hits, 0 AS impressions), " + _PAGES + " SELECT url, status FROM pg WHERE status < 300 AND contains(url, '/services/') ORDER BY inbound, indexable, status, url LIMIT 30",
}
