"""The query language over a whole report, retrieval over it, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_of, short
from ..operators import binding as B
from ..operators import claims as CL
from ..operators import content as C
from ..operators import graph as G
from ..operators import matrices as M
from ..operators import observations as O
from ..operators import vectors as V
from ..operators.common import table
from . import audit as A
from . import dsl
from . import graphs as GQ
from .evidence import SQL as EVIDENCE
from .evidence import _CUR, _docs
from .history import _REFS, _refs
from .site import _SITE, site_edges, site_pages


class Collections(Mapping):
    """Collections by name, each made only when a query asks for it."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def weighted_links(s: SparkSession, d: str) -> DataFrame:
    """Links with the weight of their place, less for those of a template."""
    e = G.template_frequency(site_edges(s, d), 6)
    return e.withColumn("weight", G.link_weight(F.col("location"), F.col("template_frequency")))


def weighted_rank(s: SparkSession, d: str) -> DataFrame:
    """Rank of every page by weighted links."""
    return G.page_rank(weighted_links(s, d)).select("node", F.round("rank", 9).alias("rank"))


def _urls(s: SparkSession, d: str) -> DataFrame:
    p = A._state(s, d)
    e = B.page_edges(p, site_edges(s, d))
    ranks = G.page_rank(weighted_links(s, d))
    profile = C.token_profile(p.select("_url", "text"), "_url")
    metrics = O.url_metrics(O.current_rows(table(s, d, "observations")))
    family = M.town_family(F.col("_path"))["family"]
    shares = A._shares(s, d).select(F.col("family").alias("_fam"), "template_shared_ratio")
    u = B.mark_inbound(p, e).withColumn("_fam", family).join(ranks.select(F.col("node").alias("_url"), "rank"), "_url", "left").join(profile.select("_url", "fact_density", F.col("function_word_ratio").alias("genericity")), "_url", "left")
    u = u.join(shares, "_fam", "left").join(metrics.withColumnRenamed("url", "_url"), "_url", "left")
    return u.select(
        F.col("_url").alias("url"), "status", (F.col("indexability") == "indexable").alias("indexable"), "inbound_links", F.round("rank", 6).alias("authority"), "in_sitemap", "title", "fact_density", "genericity",
        F.when(F.col("template_shared_ratio").isNotNull(), F.col("_fam")).alias("route_family"), F.col("template_shared_ratio").alias("boilerplate_ratio"), "gsc_clicks", "gsc_impressions", "citations",
    )


def _findings(s: SparkSession, d: str) -> DataFrame:
    last = _refs(s, d).select(F.col("latest").alias("snapshot_id"))
    return table(s, d, "findings").join(last, "snapshot_id", "left_semi").select("code", "fingerprint", "severity", "summary", "url").distinct()


def _claims(s: SparkSession, d: str) -> DataFrame:
    nodes, _ = B.claim_graph(CL.page_claims(A._state(s, d), A.PACKS, A.SIGNALS))
    return nodes.where("kind = 'claim'").select(F.col("label").alias("claim"), "id", F.lit("unmeasured").alias("support_state"))


def family_totals(p: DataFrame, rows: DataFrame, findings: DataFrame) -> DataFrame:
    """``family, gsc_clicks, gsc_impressions, error_findings``: search rows and errors of a family's pages; null where there are none.

    Pages, rows and findings meet by family, which each URL's path names; no URL is compared with every family.
    """
    family = p.select(F.regexp_replace("_url", "/+$", "").alias("_k"), M.town_family(F.col("_path"))["family"].alias("family")).where("family IS NOT NULL").distinct()
    found = rows.where("kind = 'search_performance' AND url IS NOT NULL").groupBy(F.regexp_replace("url", "/+$", "").alias("_k")).agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i"))
    bad = findings.where("severity = 'error'").groupBy(F.regexp_replace("url", "/+$", "").alias("_k")).agg(F.count(F.lit(1)).alias("e"))
    g = family.join(found, "_k", "left").join(bad, "_k", "left").groupBy("family").agg(*[F.nullif(F.coalesce(F.sum(c), F.lit(0)), F.lit(0)).alias(n) for c, n in (("c", "gsc_clicks"), ("i", "gsc_impressions"), ("e", "error_findings"))])
    return g


def _families(s: SparkSession, d: str) -> DataFrame:
    towns = A._towns(s, d)
    m = M.enrich(A._matrices(s, d, towns), A._shares(s, d, towns))
    plain = A._state(s, d)
    totals = family_totals(plain, O.current_rows(table(s, d, "observations")), _findings(s, d)).withColumnRenamed("family", "_f")
    j = m.join(totals, m["family"] == F.col("_f"), "left")
    return j.select("family", "measured_urls", "verdict", "boilerplate_ratio", "unique_fact_ratio", "estimated_cardinality", "measured_sample_rate", "doorway_risk", "cannibalization_risk", "canonical_coverage", "gsc_clicks", "gsc_impressions", "error_findings")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents that have an address; id is the address and the number."""
    docs = table(s, d, "documents").where("url IS NOT NULL").select("doc_id", "url", "text")
    c = C.sentence_chunks(docs, keep=("heading",)).join(docs.select("doc_id", "url"), "doc_id")
    return c.select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_no").cast("string")).alias("id"), "url", "heading", "citation_suitability")


def _opportunities(s: SparkSession, d: str) -> DataFrame:
    p = A._towns(s, d)
    items = A.P.difficulty_to_build(A._with_family(A._decorated(s, d, p)), A._shares(s, d, p), A._made(s, d))
    ident = F.concat(F.lit("SE-OPP-"), F.upper("kind"), F.lit(":"), short(hash_of(F.col("subject"))))
    return items.select(ident.alias("id"), "kind", "subject", "summary", "demand", "expected_ctr", "recoverable_clicks", "expected_value", "difficulty_to_rank", "difficulty_to_build")


def _runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "runs").select("snapshot_id", F.regexp_replace("site", "/+$", "").alias("site"), "mode", "measured_urls", "findings").distinct()


def report(s: SparkSession, d: str) -> Collections:
    """All seven collections of a report."""
    makers = {"urls": _urls, "findings": _findings, "claims": _claims, "route_families": _families, "chunks": _chunks, "opportunities": _opportunities, "runs": _runs}
    return Collections({k: (lambda f=f: f(s, d)) for k, f in makers.items()})


LIVE = {
    "live_urls": "FROM urls WHERE inbound_links = 0 AND indexable = TRUE LIMIT 200", "live_measured": "FROM urls WHERE gsc_impressions > 100 AND authority < 1 RETURN url, authority, gsc_clicks, citations, genericity LIMIT 200", "live_claims": "FROM claims WHERE claim = HEDGE",
    "live_families": 'FROM families WHERE verdict != "UNMEASURED" AND measured_urls >= 1 LIMIT 200', "live_chunks": "FROM chunks WHERE citation_suitability > 45 RETURN id, url, citation_suitability LIMIT 120", "live_opportunities": "FROM opportunities WHERE kind != link_gap AND difficulty_to_build < 60 LIMIT 150",
    "live_runs": "FROM snapshots WHERE measured_urls > 3 AND site contains example RETURN snapshot_id, site, findings LIMIT 60",
}


def _live(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        return dsl.run(text, report(s, d))

    query.__doc__ = text
    return query


# ---- retrieval
def similar_documents(s: SparkSession, d: str) -> DataFrame:
    """The documents most like the first one that has a text."""
    docs = _docs(s, d).select("doc_id", "text")
    return V.similar(docs, docs.where("text IS NOT NULL AND length(text) > 200").agg(F.min("doc_id")).first()[0], k=20)


def chunk_answers(s: SparkSession, d: str) -> DataFrame:
    """The chunks nearest to a question."""
    c = C.sentence_chunks(_docs(s, d), keep=("body",))
    return V.chunks_for(c, GQ.ASKED, k=12, order=("doc_id", "chunk_no")).select("doc_id", "chunk_no", "relevance")


def passage_rules(s: SparkSession, d: str) -> DataFrame:
    """Searches that no passage of their page answers; the pages' texts are their titles and addresses."""
    p = A._state(s, d).select(F.col("_url").alias("url"), F.coalesce("title", F.lit("")).alias("heading"), F.col("text").alias("body"))
    return V.passage_gaps(O.current_rows(table(s, d, "observations")), p)


def intent_rules(s: SparkSession, d: str) -> DataFrame:
    """Pages that ask for the same: every hundredth page against all."""
    p = A._state(s, d)
    return V.same_intent(p, _near(p, 0.86))


def link_plan(s: SparkSession, d: str) -> DataFrame:
    """Links that every hundredth page lacks, with the words to set them on."""
    p = A._state(s, d).withColumn("_linked", F.col("inbound") > 0)
    profiles = V.link_profiles(p, G.page_rank(site_edges(s, d)))
    return V.anchor_texts(V.recommend_links(profiles, _near(p, 0.12), site_edges(s, d)), p).select("url", "target", "rank", "severity", "anchor", "found")


def _near(p: DataFrame, least: float) -> DataFrame:
    """Pairs of pages by the cosine of their lexical embeddings; queries are the pages whose number is divisible by 100."""
    from ..functions.text import tokens

    e = p.where("_ok").select("ordinal", V.lexical_embedding(tokens(F.col("text"))).alias("embedding"))
    hits = V.nearest(e, e.where("ordinal % 100 = 0"), "ordinal", "embedding", None, least)
    names = p.select("ordinal", "_url")
    return hits.join(names.select(F.col("ordinal").alias("query_id"), F.col("_url").alias("a")), "query_id").join(names.select(F.col("ordinal").alias("hit_id"), F.col("_url").alias("b")), "hit_id").select("a", "b", F.round("cosine", 6).alias("cosine"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _live(v) for k, v in LIVE.items()} | {f.__name__: f for f in (weighted_rank, similar_documents, chunk_answers, passage_rules, intent_rules, link_plan)}

_WEIGHTS = "wl AS (SELECT src, dst, CASE location WHEN 'header' THEN 0.4 WHEN 'nav' THEN 0.3 WHEN 'footer' THEN 0.15 ELSE 1.0 END::DOUBLE * CASE WHEN n >= 3 THEN 0.25 ELSE 1.0 END AS weight FROM (SELECT *, count(*) OVER (PARTITION BY dst, location) AS n FROM ed))"
_WRANK = f"{_WEIGHTS}, e AS (SELECT src, dst, weight FROM wl), " + GQ.SQL["page_rank"].removeprefix(f"WITH {GQ._LINKS}, ").removesuffix(" SELECT node, round(rank, 9) AS rank FROM r20").replace("count(*)::DOUBLE AS w", "sum(weight)::DOUBLE AS w")
_PROFILES = EVIDENCE["doc_profile"].replace("doc_id", "url").replace("FROM documents WHERE text IS NOT NULL", "FROM ap")
_METRICS = "ME AS (SELECT url, sum(clicks) FILTER (kind = 'search_performance')::BIGINT AS gsc_clicks, sum(impressions) FILTER (kind = 'search_performance')::BIGINT AS gsc_impressions, nullif(count(*) FILTER (kind = 'ai_citation'), 0) AS citations FROM cur WHERE url IS NOT NULL GROUP BY url)"
_URLS = f"""{A._TOWNS}, {_CUR}, {_WRANK}, pf AS ({_PROFILES}), {_METRICS}, ib AS (SELECT dst, count(*) AS n FROM ed GROUP BY 1), fo AS (SELECT url, CASE WHEN len(x) IN (2, 3) AND x[1] IN ('category', 'services') AND (len(x) = 2 OR contains(x[3], '-') OR strlen(x[3]) >= 4) THEN 'category/' || x[2] END AS fam FROM (SELECT url, CASE WHEN s[1] IN ('en', 'ru', 'he', 'es', 'fr', 'de') THEN s[2:] ELSE s END AS x FROM (SELECT url, list_filter(string_split(path, '/'), lambda v: v <> '') AS s FROM ap))),
ur AS (SELECT ap.url, ap.status, ap.ix = 'indexable' AS indexable, coalesce(ib.n, 0) AS inbound_links, round(r20.rank, 6) AS authority, in_map AS in_sitemap, ti AS title, fact_density, function_word_ratio AS genericity, CASE WHEN sh.template_shared_ratio IS NOT NULL THEN fo.fam END AS route_family, sh.template_shared_ratio AS boilerplate_ratio, gsc_clicks, gsc_impressions, citations
  FROM ap LEFT JOIN ib ON ib.dst = ap.url LEFT JOIN r20 ON r20.node = ap.url LEFT JOIN pf ON pf.url = ap.url LEFT JOIN fo ON fo.url = ap.url LEFT JOIN sh ON sh.family = fo.fam LEFT JOIN ME m ON m.url = ap.url)"""
_UORDER = "ORDER BY authority NULLS LAST, boilerplate_ratio NULLS LAST, citations NULLS LAST, fact_density NULLS LAST, genericity NULLS LAST, gsc_clicks NULLS LAST, gsc_impressions NULLS LAST, in_sitemap NULLS LAST, inbound_links, indexable, route_family NULLS LAST, status, title NULLS LAST, url"
_ENRICHED = A.SQL["matrix_enriched"]
_ASKED_TOKENS = str([w.lower() for w in GQ.ASKED.split()])


def _lexical_over(source: str, asked: str) -> str:
    """The lexical part of retrieval over rows ``doc_id, text`` for a list of tokens."""
    return GQ._LEXICAL.replace("FROM documents WHERE text IS NOT NULL", f"FROM {source} WHERE text IS NOT NULL").replace(_ASKED_TOKENS, asked)


_TOKENS = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CHUNK_SQL = EVIDENCE["doc_chunks"]
SQL: dict[str, str] = {
    "weighted_rank": f"WITH {_SITE}, {_WRANK} SELECT node, round(rank, 9) AS rank FROM r20",
    "live_urls": f"WITH {_URLS} SELECT * FROM ur WHERE inbound_links = 0 AND indexable {_UORDER} LIMIT 200",
    "live_measured": f"WITH {_URLS} SELECT authority, citations, genericity, gsc_clicks, url FROM ur WHERE gsc_impressions > 100 AND authority < 1 {_UORDER} LIMIT 200",
    "live_claims": f"WITH {A._MARKET} SELECT DISTINCT 'hedge' AS claim, 'claim:north#hedge' AS id, 'unmeasured' AS support_state FROM mk WHERE status < 400 AND market = 'de' AND (contains(text, 'hedge-care') OR contains(text, 'hedge-trim'))",
    "live_chunks": f"WITH k AS ({_CHUNK_SQL}) SELECT 'chunk:' || doc_id || '#' || chunk_no AS id, url, citation_suitability FROM k JOIN documents USING (doc_id) WHERE url IS NOT NULL AND citation_suitability > 45 ORDER BY citation_suitability, {{heading}} NULLS LAST, id, url LIMIT 120",
    "live_runs": "SELECT findings, site, snapshot_id FROM (SELECT DISTINCT snapshot_id, regexp_replace(site, '/+$', '') AS site, mode, measured_urls, findings FROM runs) WHERE measured_urls > 3 AND contains(lower(site), 'example') ORDER BY findings NULLS LAST, measured_urls NULLS LAST, mode NULLS LAST, site NULLS LAST, snapshot_id NULLS LAST LIMIT 60",
    "similar_documents": "WITH o AS (SELECT min(doc_id) AS id FROM documents WHERE text IS NOT NULL AND length(text) > 200), q AS (SELECT " + _TOKENS.format("text") + " AS w FROM documents, o WHERE doc_id = id), " + _lexical_over("documents", "(SELECT w FROM q)") + f""", p AS (SELECT lx.doc_id, lexical, len(list_filter(w, lambda t: strlen(t) > 3 AND contains({_LOWER.format('text')}, t))) AS entities, len(list_filter(w, lambda t: contains({_LOWER.format('text')}, t))) AS present FROM lx JOIN documents d ON d.doc_id = lx.doc_id, q)
      SELECT doc_id, lexical, entities::INT AS entities FROM (SELECT * FROM p WHERE lexical >= 40 OR present > 0 ORDER BY lexical DESC, entities DESC, doc_id LIMIT 20), o WHERE doc_id <> id""",
    "passage_rules": f"""WITH {_SITE}, {_CUR}, a AS (SELECT row_id, url, page_url, query, list_filter(list_transform(string_split_regex(query, '[^\\p{{L}}\\p{{N}}]+'), lambda x: {_LOWER.format('x')}), lambda x: strlen(x) >= 3) AS w FROM cur WHERE kind = 'search_performance' AND impressions >= 30 AND strlen(query) > 3 AND url IS NOT NULL),
      h AS (SELECT rtrim(url, '/') AS k, {_LOWER.format("coalesce(title, '') || ' ' || text")} AS hay FROM (SELECT url, ti AS title, text FROM ap)), b AS (SELECT row_id, a.url, query, max(len(list_filter(w, lambda t: contains(hay, t))) * 100 // len(w)) AS best FROM a LEFT JOIN h ON h.k = a.page_url WHERE len(w) > 0 GROUP BY 1, 2, 3)
      SELECT row_id, 'SE-CONTENT-004' AS code, 'info' AS severity, url, query AS subject, coalesce(best, 0)::INT AS best FROM b WHERE coalesce(best, 0) < 40""",
}
SQL["live_chunks"] = SQL["live_chunks"].replace("SELECT doc_id, chunk_no::INT AS chunk_no, n AS n_tokens", "SELECT doc_id, heading, chunk_no::INT AS chunk_no, n AS n_tokens").replace("{heading}", "heading")
_CUT = EVIDENCE["doc_chunks"].split("t AS (SELECT doc_id, chunk_no, heading")[0].rstrip().rstrip(",")
SQL["chunk_answers"] = f"WITH ck AS ({_CUT} SELECT doc_id * 100000 + chunk_no AS doc_id, text FROM c), " + _lexical_over("ck", _ASKED_TOKENS) + " SELECT doc_id // 100000 AS doc_id, (doc_id % 100000)::INT AS chunk_no, lexical AS relevance FROM lx ORDER BY lexical DESC, lx.doc_id LIMIT 12"
_NO_TOWN_FAMILY = "CASE WHEN len(x) IN (2, 3) AND x[1] IN ('category', 'services') AND (len(x) = 2 OR contains(x[3], '-') OR strlen(x[3]) >= 4) THEN 'category/' || x[2] END"
SQL["live_families"] = f"""WITH c AS ({A.SQL["matrix_compiled"]}), e AS ({_ENRICHED}), {_REFS}, {_CUR}, pg AS (SELECT DISTINCT rtrim(url, '/') AS k, {_NO_TOWN_FAMILY} AS fam FROM (SELECT url, CASE WHEN s[1] IN ('en', 'ru', 'he', 'es', 'fr', 'de') THEN s[2:] ELSE s END AS x FROM (SELECT url, list_filter(string_split(coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/'), '/'), lambda v: v <> '') AS s FROM pages WHERE snapshot_id IN (SELECT latest FROM refs)))),
  sr AS (SELECT page_url AS k, sum(clicks) AS c, sum(impressions) AS i FROM cur WHERE kind = 'search_performance' AND url IS NOT NULL GROUP BY 1), er AS (SELECT rtrim(url, '/') AS k, count(*) AS e FROM (SELECT DISTINCT code, fingerprint, severity, summary, url FROM findings WHERE snapshot_id IN (SELECT latest FROM refs) AND severity = 'error') GROUP BY 1),
  tt AS (SELECT fam, nullif(coalesce(sum(sr.c), 0), 0)::BIGINT AS gsc_clicks, nullif(coalesce(sum(sr.i), 0), 0)::BIGINT AS gsc_impressions, nullif(coalesce(sum(er.e), 0), 0)::BIGINT AS error_findings FROM pg LEFT JOIN sr USING (k) LEFT JOIN er USING (k) WHERE fam IS NOT NULL GROUP BY 1)
  SELECT e.family, c.measured_urls, e.verdict, e.boilerplate_ratio, e.unique_fact_ratio, c.estimated_cardinality, c.measured_sample_rate, e.doorway_risk, c.cannibalization_risk, c.canonical_coverage, tt.gsc_clicks, tt.gsc_impressions, tt.error_findings FROM e JOIN c ON c.family = e.family LEFT JOIN tt ON tt.fam = e.family WHERE lower(e.verdict) <> 'unmeasured' AND c.measured_urls >= 1
  ORDER BY e.boilerplate_ratio NULLS LAST, c.cannibalization_risk NULLS LAST, c.canonical_coverage NULLS LAST, e.doorway_risk NULLS LAST, error_findings NULLS LAST, c.estimated_cardinality NULLS LAST, e.family LIMIT 200"""
_SUMMARY = "CASE x.kind WHEN 'link_gap' THEN ' is indexable but has no internal inlinks from the seed' WHEN 'sitemap_gap' THEN ' is linked and indexable but absent from the sitemap' WHEN 'content_gap' THEN ' has no H1' WHEN 'cannibal' THEN ' variants should be consolidated' WHEN 'create_family' THEN ' needs unique facts before expansion' ELSE ' should stay out of the index by default' END"
SQL["live_opportunities"] = f"""WITH x AS ({A.SQL["opportunity_axes"]}), y AS ({A.SQL["opportunity_build"]}), z AS (SELECT 'SE-OPP-' || upper(x.kind) || ':' || lower(lpad(to_hex(({GQ.fnv_sql("x.subject")}).d), 8, '0')) AS id, x.kind, x.subject, x.subject || {_SUMMARY} AS summary, demand, expected_ctr, recoverable_clicks, expected_value, difficulty_to_rank, y.difficulty_to_build FROM x JOIN y ON x.kind = y.kind AND x.subject = y.subject)
  SELECT * FROM z WHERE lower(kind) <> 'link_gap' AND difficulty_to_build < 60 ORDER BY demand NULLS LAST, difficulty_to_build NULLS LAST, difficulty_to_rank NULLS LAST, expected_ctr NULLS LAST, expected_value NULLS LAST, id, kind, recoverable_clicks NULLS LAST, subject, summary LIMIT 150"""
