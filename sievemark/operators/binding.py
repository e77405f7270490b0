"""The evidence graph: nodes and facts of pages, schema, chunks, routes, markets and rendered pages; and chains through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import join_url

# How a chain goes on from a page, from its route, from a claim and from the claim's field.
_FROM_URL = ["rendered_by", "claims", "about", "compared_against", "changed_by"]
_NEXT = [("rendered_by", ["metadata_from", "generated_by"]), ("claims", ["governed_by", "requires"]), ("requires", ["defined_at"])]


def page_edges(p: DataFrame, links: DataFrame) -> DataFrame:
    """``src, dst, relation``: canonicals, alternates, redirects, sitemap entries and links of pages.

    ``links`` is src and dst; self references are none.
    """
    one = lambda df, dst, relation: df.select(F.col("_url").alias("src"), dst.alias("dst"), F.lit(relation).alias("relation")).where("dst IS NOT NULL AND dst <> src")
    hops = p.select("_url", F.explode("redirects").alias("h"))
    maps = p.where("in_sitemap").select("_url", F.concat(F.regexp_extract("_url", "^([a-z]+://[^/?#]+)", 1), F.lit("/sitemap.xml")).alias("_map"))
    alternates = p.select("_url", F.explode("alternates").alias("a"))
    return (
        one(p, F.col("_canon"), "canonical_to").unionByName(one(alternates, join_url(F.col("_url"), F.col("a.href")), "alternate_of")).unionByName(one(hops, join_url(F.col("_url"), F.col("h.to")), "redirects_to"))
        .unionByName(one(maps, F.col("_map"), "listed_in_sitemap")).unionByName(links.select("src", "dst", F.lit("links_to").alias("relation")))
    )


def mark_inbound(p: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``inbound_links`` and ``_linked``: whether any page links to it, which a home page needs not."""
    n = edges.where("relation = 'links_to'").groupBy(F.col("dst").alias("_url")).agg(F.count(F.lit(1)).alias("inbound_links"))
    return p.join(n, "_url", "left").withColumn("inbound_links", F.coalesce("inbound_links", F.lit(0))).withColumn("_linked", (F.col("inbound_links") > 0) | (F.col("_path") == "/"))


def bind(p: DataFrame, chunks: DataFrame | None = None, routes: DataFrame | None = None, matches: DataFrame | None = None, markets: DataFrame | None = None, rendered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts) as ``id, kind, label`` and ``source, target, relation``, each once.

    ``chunks`` is url, chunk_no, heading; ``routes`` pattern, owner; ``matches`` path, pattern; ``markets`` url, market;
    ``rendered`` url. What isn't given adds nothing.
    """
    node = lambda df, i, kind, label: df.select(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    fact = lambda df, s, t, relation: df.select(s.alias("source"), t.alias("target"), F.lit(relation).alias("relation"))
    url = lambda c: F.concat(F.lit("url:"), F.col(c))
    nodes = node(p, url("_url"), "url", F.col("_url"))
    blocks = p.select("_url", F.explode("json_ld").alias("b"))
    types = blocks.select("_url", F.explode(F.when(F.size("b.nodes") > 0, F.transform("b.nodes", lambda n: F.coalesce(F.try_element_at(n["types"], F.lit(1)), F.lit("Thing")))).otherwise(F.col("b.types"))).alias("_t"))
    schema = F.concat(F.lit("schema:"), F.col("_url"), F.lit("#"), F.col("_t"))
    nodes, facts = nodes.unionByName(node(types, schema, "schema_object", F.col("_t"))), fact(types, url("_url"), schema, "declares")
    if chunks is not None:
        c = F.concat(F.lit("chunk:"), F.col("url"), F.lit("#"), F.col("chunk_no").cast("string"))
        nodes, facts = nodes.unionByName(node(chunks, c, "chunk", F.col("heading"))), facts.unionByName(fact(chunks, url("url"), c, "contains"))
    if routes is not None:
        r, s = F.concat(F.lit("route:"), F.col("pattern")), F.concat(F.lit("symbol:"), F.col("owner"), F.lit("#module"))
        nodes, facts = nodes.unionByName(node(routes, r, "route_family", F.col("pattern"))).unionByName(node(routes, s, "source_symbol", F.col("owner"))), facts.unionByName(fact(routes, r, s, "generated_by"))
    if matches is not None:
        pages = p.select("_url", "_path").join(matches, F.col("_path") == matches["path"])
        facts = facts.unionByName(fact(pages, url("_url"), F.concat(F.lit("route:"), F.col("pattern")), "rendered_by"))
    if markets is not None:
        m = F.concat(F.lit("market:"), F.col("market"))
        nodes, facts = nodes.unionByName(node(markets, m, "market", F.col("market"))), facts.unionByName(fact(markets, url("url"), m, "about"))
    if rendered is not None:
        r = F.concat(F.lit("render:"), F.col("url"))
        nodes, facts = nodes.unionByName(node(rendered, r, "search_observation", F.col("url"))), facts.unionByName(fact(rendered, url("url"), r, "observed_as"))
    return nodes.distinct(), facts.distinct()


def claim_graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts) of claims (url, claim, pack, requires): page to claim, claim to pack and to the field it needs."""
    c, f, k = F.concat(F.lit("claim:"), F.col("pack"), F.lit("#"), F.col("claim")), F.concat(F.lit("field:"), F.col("pack"), F.lit("#"), F.col("requires")), F.concat(F.lit("policy:"), F.col("pack"))
    node = lambda i, kind, label: claims.select(i.alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
    fact = lambda s, t, relation: claims.select(s.alias("source"), t.alias("target"), F.lit(relation).alias("relation"))
    nodes = node(c, "claim", "claim").unionByName(node(f, "data_field", "requires")).unionByName(node(k, "policy", "pack"))
    facts = fact(F.concat(F.lit("url:"), F.col("url")), c, "claims").unionByName(fact(c, k, "governed_by")).unionByName(fact(c, f, "requires"))
    return nodes.distinct(), facts.distinct()


def explain(subjects: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``subject, hop, relation, node, kind``: what stands behind each subject (a column ``subject`` with URLs).

    From a page to its route and on to the symbols that make it; to its claims, their policy and fields, and where fields are defined; to what it
    is about and compared with. At most three hops, each node once per subject at its shortest distance; a subject without facts is its own chain.
    """
    f = facts.select("source", "target", "relation").distinct()
    front = subjects.select("subject", F.concat(F.lit("url:"), F.col("subject")).alias("node"), F.lit("").alias("relation"), F.lit(0).alias("hop")).distinct()
    chain = front
    for hop in range(1, 4):
        allowed = F.col("_r").isin(_FROM_URL) if hop == 1 else F.lit(False)
        if hop > 1:
            for before, after in _NEXT:
                allowed = allowed | ((F.col("relation") == before) & F.col("_r").isin(after))
        front = front.join(f.select(F.col("source").alias("node"), F.col("target").alias("_to"), F.col("relation").alias("_r")), "node").where(allowed).select("subject", F.col("_to").alias("node"), F.col("_r").alias("relation"), F.lit(hop).alias("hop")).distinct()
        chain = chain.unionByName(front)
    best = chain.groupBy("subject", "node").agg(F.min(F.struct("hop", "relation")).alias("m"))
    kinds = nodes.groupBy(F.col("id").alias("node")).agg(F.min("kind").alias("kind"))
    return best.join(kinds, "node", "left").select("subject", "m.hop", "m.relation", "node", F.coalesce("kind", F.split("node", ":")[0]).alias("kind"))
