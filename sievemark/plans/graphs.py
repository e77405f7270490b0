"""Queries over graphs, near-duplicates, vectors and retrieval, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import OFFSET
from ..functions.urls import url_parts
from ..operators import graph as G
from ..operators import similarity as S
from ..operators import vectors as V
from ..operators.common import table

ASKED = "Which canonical redirect drops out of the crawl index"


def _links(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "fact_edges").where("source_kind = 'url' AND target_kind = 'url' AND source <> '' AND target <> ''")
    return e.select("edge_id", F.col("source").alias("src"), F.col("target").alias("dst"), F.col("evidence_source").alias("location")).distinct()


def link_degrees(s: SparkSession, d: str) -> DataFrame:
    """Inbound and outbound links per page."""
    return G.degrees(_links(s, d))


def link_templates(s: SparkSession, d: str) -> DataFrame:
    """Links whose target and place repeat on the linking site, with their weight. A site's pages
    are its URLs that any snapshot found indexable, as links aren't kept by snapshot."""
    site = lambda url: url_parts(url)["host"]
    pages = table(s, d, "pages").select("url", "indexable").withColumn("site", site(F.col("url"))).where("site IS NOT NULL")
    sizes = pages.groupBy("site").agg(F.greatest(F.countDistinct(F.when(F.col("indexable") == "indexable", F.col("url"))), F.lit(1)).alias("n_pages"))
    e = _links(s, d).withColumn("site", site(F.regexp_replace("src", "^url:", ""))).join(sizes, "site", "left")
    t = G.template_frequency(e, F.col("n_pages"), ("site",))
    return t.select("edge_id", "src", "dst", "template_frequency", F.round(G.link_weight(F.lit("nav"), F.col("template_frequency")), 6).alias("weight"))


def link_depth(s: SparkSession, d: str) -> DataFrame:
    """Hops of every page from the home pages."""
    e = _links(s, d)
    seeds = e.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").rlike("^url:[^:]+://[^/]+/$")).distinct()
    return G.depths(e, seeds)


def page_rank(s: SparkSession, d: str) -> DataFrame:
    """Rank of every page after 20 rounds."""
    return G.page_rank(_links(s, d)).select("node", F.round("rank", 9).alias("rank"))


def link_components(s: SparkSession, d: str) -> DataFrame:
    """Connected components of all typed facts between nodes."""
    e = table(s, d, "fact_edges").where("source <> '' AND target <> ''").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return G.components(e)


def near_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Near-duplicate class of every document: five-word shingles, similarity 0.8."""
    return S.near_duplicate_classes(table(s, d, "documents").select("doc_id", "text"))


def similar_pairs(s: SparkSession, d: str) -> DataFrame:
    """Links between representatives of different shingle sets."""
    links, _ = S.similar_pairs(table(s, d, "documents").select("doc_id", "text"))
    return links.select("a", "b", "common", F.round("similarity", 6).alias("similarity"))


def vector_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(e, e.where("vec_id % 100 = 0"), k=10).select("query_id", "hit_id", F.round("cosine", 5).alias("cosine"), "rank")


def link_recommendations(s: SparkSession, d: str) -> DataFrame:
    """Up to three link targets of at least 0.12 cosine for every hundredth vector."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(e, e.where("vec_id % 100 = 0"), k=3, least=0.12).select("query_id", "hit_id", "rank")


def retrieve_documents(s: SparkSession, d: str) -> DataFrame:
    """The best documents for a question, by lexical embedding and tokens."""
    return V.retrieve(table(s, d, "documents").select("doc_id", "text"), ASKED)


def keyword_documents(s: SparkSession, d: str) -> DataFrame:
    """The documents that contain most of a question's words."""
    return V.keyword_retrieve(table(s, d, "documents").select("doc_id", "text"), ASKED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (link_degrees, link_templates, link_depth, page_rank, link_components, near_duplicates, similar_pairs, vector_neighbours, link_recommendations, retrieve_documents, keyword_documents)
}

_LINKS = "e AS (SELECT DISTINCT edge_id, source AS src, target AS dst, evidence_source AS location FROM fact_edges WHERE source_kind = 'url' AND target_kind = 'url' AND source <> '' AND target <> '')"
_ASKED = sorted({w.lower() for w in ASKED.split()})
_ROUND = """r{k} AS (SELECT n.node, n.dangling, 0.15 / n.cnt + 0.85 * (SELECT coalesce(sum(rank) FILTER (dangling), 0) FROM r{j}) / n.cnt + 0.85 * coalesce(g.got, 0) AS rank
  FROM n LEFT JOIN (SELECT p.dst AS node, sum(p.p * r.rank) AS got FROM p JOIN r{j} r ON r.node = p.src GROUP BY 1) g ON g.node = n.node)"""
_SETS = """t AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2) AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(t) < 5 THEN t ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END)) AS s FROM t WHERE len(t) > 0),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS rep FROM s), reps AS (SELECT doc_id AS rep, s, len(s) AS n FROM m WHERE doc_id = rep), x AS (SELECT rep, n, unnest(s) AS h FROM reps),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common, a.n + b.n - count(*) AS u FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 GROUP BY a.rep, b.rep, a.n, b.n),
l AS (SELECT a, b, common, common / u AS similarity FROM c WHERE common / u >= 0.8 - 1e-12)"""



def fnv_sql(text: str) -> str:
    """128-bit FNV-1a of a text as a struct of four 32-bit limbs, d the highest."""
    nibble = "(strpos('0123456789ABCDEF', substr(hex({t}), {i}, 1)) - 1)"
    byte = f"{nibble.format(t=text, i='2 * i - 1')} * 16 + {nibble.format(t=text, i='2 * i')}"
    m, x = "4294967295", "xor(s.a, v.x)"
    limbs = [(OFFSET >> (32 * i)) & 0xFFFFFFFF for i in range(4)]
    b, c = f"(s.b * 315 + (({x} * 315) >> 32))", "(s.c * 315 + ({b} >> 32) + ({x} << 24))"
    c = c.format(b=b, x=x)
    step = f"{{'a': ({x} * 315) & {m}, 'b': {b} & {m}, 'c': {c} & {m}, 'd': (s.d * 315 + ({c} >> 32) + (s.b << 24)) & {m}, 'x': 0::BIGINT}}"
    return f"list_reduce(list_transform(range(1, strlen({text}) + 1), lambda i: {{'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT, 'd': 0::BIGINT, 'x': ({byte})::BIGINT}}), lambda s, v: {step}, {{'a': {limbs[0]}::BIGINT, 'b': {limbs[1]}::BIGINT, 'c': {limbs[2]}::BIGINT, 'd': {limbs[3]}::BIGINT, 'x': 0::BIGINT}})"


_SLOTS = "u AS (SELECT t, (h.d >> 16) % 64 AS idx, CASE WHEN ((h.d >> 12) & 15) < 10 THEN CASE WHEN ((h.d >> 12) & 1) = 0 THEN 1 ELSE -1 END ELSE CASE WHEN ((h.d >> 12) & 1) = 1 THEN 1 ELSE -1 END END AS sign FROM (SELECT t, " + fnv_sql("t") + " AS h FROM (SELECT DISTINCT t FROM tk)))"
_LEXICAL = f"""tk AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2)) AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT -1, unnest({[w.lower() for w in ASKED.split()]})), {_SLOTS},
 v AS (SELECT doc_id, idx, sum(sign)::DOUBLE AS x FROM tk JOIN u USING (t) GROUP BY 1, 2), nm AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1),
 dt AS (SELECT a.doc_id, sum(a.x * q.x) AS d FROM v a JOIN v q ON q.doc_id = -1 AND q.idx = a.idx GROUP BY 1), lx AS (SELECT nm.doc_id, coalesce(round(100 * greatest(coalesce(d, 0) / nullif(nm.n * (SELECT n FROM nm WHERE doc_id = -1), 0), 0)), 0)::INT AS lexical FROM nm LEFT JOIN dt USING (doc_id) WHERE nm.doc_id >= 0)"""
_HAS = lambda words: " + ".join(f"contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{w}')::INT" for w in words)
SQL: dict[str, str] = {
    "retrieve_documents": f"WITH {_LEXICAL} SELECT doc_id, lexical, entities FROM (SELECT doc_id, lexical, {_HAS([w.lower() for w in ASKED.split() if len(w) > 3])} AS entities, {_HAS([w.lower() for w in ASKED.split()])} AS present FROM lx JOIN documents USING (doc_id)) WHERE lexical >= 40 OR present > 0 ORDER BY lexical DESC, entities DESC, doc_id LIMIT 8",
    "link_degrees": f"WITH {_LINKS}, o AS (SELECT src AS node, count(*) AS o, 0 AS i FROM e GROUP BY 1 UNION ALL SELECT dst, 0, count(*) FROM e GROUP BY 1) SELECT node, sum(o)::BIGINT AS outbound, sum(i)::BIGINT AS inbound FROM o GROUP BY 1",
    "link_templates": f"""WITH {_LINKS}, sz AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS site, greatest(count(DISTINCT CASE WHEN indexable = 'indexable' THEN url END), 1) AS n_pages FROM pages GROUP BY 1),
      k AS (SELECT *, regexp_extract(src, '^url:[a-z]+://([^/?#:]*)', 1) AS site FROM e), c AS (SELECT k.*, n_pages, count(*) OVER (PARTITION BY k.site, dst, coalesce(location, 'contextual')) AS n FROM k LEFT JOIN sz USING (site)),
      t AS (SELECT edge_id, src, dst, CASE WHEN n >= 3 AND 2 * n >= n_pages THEN n END AS template_frequency FROM c) SELECT *, round(0.3 * CASE WHEN template_frequency >= 3 THEN 0.25 ELSE 1.0 END, 6)::DOUBLE AS weight FROM t""",
    "link_depth": f"WITH RECURSIVE {_LINKS}, nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), b(node, depth) USING KEY (node) AS (SELECT node, 0 FROM nodes WHERE regexp_matches(node, '^url:[^:]+://[^/]+/$') UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node LEFT JOIN recurring.b r ON r.node = e.dst WHERE r.node IS NULL) SELECT node, depth FROM b",
    "page_rank": f"WITH {_LINKS}, a AS (SELECT src, dst, count(*)::DOUBLE AS w FROM e GROUP BY 1, 2), p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM a), u AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS MATERIALIZED (SELECT node, (SELECT count(*) FROM u) AS cnt, node NOT IN (SELECT src FROM p) AS dangling FROM u), r0 AS (SELECT node, dangling, 1.0::DOUBLE / cnt AS rank FROM n), "
    + ", ".join(_ROUND.format(k=k, j=k - 1).replace(f"r{k} AS (", f"r{k} AS MATERIALIZED (") for k in range(1, 21))
    + " SELECT node, round(rank, 9) AS rank FROM r20",
    "similar_pairs": f"WITH {_SETS} SELECT a, b, common, round(similarity, 6) AS similarity FROM l",
    "vector_neighbours": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, hit_id) AS rank FROM s) SELECT query_id, hit_id, round(c, 5) AS cosine, rank FROM r WHERE rank <= 10",
    "link_recommendations": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, hit_id) AS rank FROM s WHERE c >= 0.12) SELECT query_id, hit_id, rank FROM r WHERE rank <= 3",
    "keyword_documents": "SELECT doc_id, " + " + ".join(f"contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{w}')::INT" for w in _ASKED) + " AS entities FROM documents WHERE text IS NOT NULL ORDER BY entities DESC, doc_id LIMIT 8",
}
SQL["link_components"] = "WITH RECURSIVE e AS (SELECT DISTINCT source AS s, target AS t FROM fact_edges WHERE source <> '' AND target <> '' AND source <> target), b AS (SELECT s, t FROM e UNION SELECT t, s FROM e), c(node, component) USING KEY (node) AS (SELECT s, least(min(t), s) FROM b GROUP BY s UNION SELECT b.s, min(c.component) FROM c JOIN b ON b.t = c.node JOIN recurring.c r ON r.node = b.s WHERE c.component < r.component GROUP BY b.s) SELECT node, component FROM c"
