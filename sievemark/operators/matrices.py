"""Page matrices of route families: verdicts, gates and what content and demand add to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, collapse
from ..functions.urls import FAMILY_LOCALES, let, segments

# Gates in their order with their label, those that must pass, and segments that are no town.
GATES = {
    "sample_diversity": "sufficient sample diversity", "fact_coverage": "fact coverage", "semantic_distinctness": "semantic distinctness", "canonical_strategy": "canonical strategy",
    "discovery_support": "discovery support beyond sitemap", "claim_integrity": "claim integrity", "demand_evidence": "demand evidence", "cannibalization_risk": "cannibalization risk",
    "internal_link_support": "internal link support", "doorway_risk": "doorway risk", "conversion_readiness": "conversion readiness",
}
REQUIRED = ["sample_diversity", "fact_coverage", "semantic_distinctness", "canonical_strategy"]
NO_TOWN = ["prices", "reviews", "about", "new", "edit", "index", "all"]


def _rest(path: Column) -> Column:
    """Segments without a leading locale."""
    return let(segments(path), lambda s: F.when(F.try_element_at(s, F.lit(1)).isin(FAMILY_LOCALES), F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))).otherwise(s))


def town_family(path: Column) -> Column:
    """struct<family, town> of [locale]/(category|services)/slug[/town]: town is null without one; null for other paths."""
    def build(r: Column) -> Column:
        at = lambda i: F.try_element_at(r, F.lit(i))
        town = at(3).contains("-") | (F.octet_length(at(3)) >= 4)
        ok = at(1).isin("category", "services") & ((F.size(r) == 2) | ((F.size(r) == 3) & town))
        return F.when(ok, F.struct(F.concat(F.lit("category/"), at(2)).alias("family"), F.when(F.size(r) == 3, at(3)).alias("town")))

    return let(_rest(path), build)


def strip_town(text: Column, town: Column) -> Column:
    """A text without the name of a town: as a slug, with blanks, and without its two-letter region; lower case, white space collapsed."""
    low, slug = ascii_lower(text), ascii_lower(town)
    plain = F.replace(slug, F.lit("-"), F.lit(" "))
    bare = F.replace(F.replace(low, slug, F.lit(" ")), plain, F.lit(" "))
    region = F.regexp_extract(slug, "^(.+)-([^-]{2})$", 1)
    name = F.replace(region, F.lit("-"), F.lit(" "))
    return collapse(F.when(region != "", F.replace(bare, name, F.lit(" "))).otherwise(bare))


def thin_towns(p: DataFrame) -> DataFrame:
    """PROG-002: town pages of a family that say the same once the town's name is taken out; one finding per group, its first page as url."""
    place = town_family(F.col("_path"))
    q = p.where("_ok").where(F.trim("text") != "").select("_url", place.alias("_f"), "text").where(F.col("_f.town").isNotNull() & ~F.col("_f.town").isin(NO_TOWN))
    bare = q.select("_url", F.col("_f.family").alias("family"), strip_town(F.col("text"), F.col("_f.town")).alias("_t")).where("_t <> ''")
    g = bare.groupBy("family", F.md5(F.encode("_t", "utf-8")).alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.min("_url").alias("url")).where("n > 1")
    return g.select(F.lit("SE-PROG-002").alias("code"), F.lit("PROG").alias("family_code"), F.lit("warn").alias("severity"), "url", F.concat(F.col("family"), F.lit(":"), F.col("n").cast("string")).alias("subject")).withColumnRenamed("family_code", "family")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.floor(part * 100 / F.nullif(whole, F.lit(0))), F.lit(100)).cast("int"))


def compile_matrices(p: DataFrame, edges: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """One row per family of pages with status 200 and per predicted dynamic pattern.

    Gives the counts, ``verdict``, ``gates`` (map of gate to passed, failed or unmeasured), the estimated number of pages (towns seen in
    paths and in links under the family) and the shares that rest on pages alone. ``predicted`` has a
    column ``pattern``; its families without pages are unmeasured. ``edges`` has ``dst``. Pages need ``_linked``.
    """
    q = p.where("status = 200").withColumn("_f", town_family(F.col("_path"))).where("_f IS NOT NULL").withColumns({"family": F.col("_f.family"), "_town": F.col("_f.town")})
    idx = F.col("indexability") == "indexable"
    canonical = F.coalesce(F.col("canonical") != "", F.lit(False))
    visible = F.md5(F.encode(collapse(F.concat_ws(" ", F.array_join(F.transform("headings", lambda h: h["text"]), " "), F.col("text"))), "utf-8"))
    g = q.groupBy("family").agg(
        F.count(F.lit(1)).alias("measured_urls"), F.count_if(idx).alias("n_indexable"), F.countDistinct(F.when(idx, visible)).alias("n_unique"), F.count_if(idx & canonical).alias("n_canonical"), F.bool_and(F.col("in_sitemap") & ~F.col("_linked")).alias("_map_only"), F.min("_url").alias("first_page")
    )
    towns = q.where(F.col("_town").isNotNull() & ~F.col("_town").isin(NO_TOWN)).select("family", F.col("_town").alias("_slug"))
    linked = edges.select(F.regexp_extract("dst", "/(category/[^/?#]+)/([^/?#]*)", 1).alias("family"), F.regexp_extract("dst", "/(category/[^/?#]+)/([^/?#]*)", 2).alias("_slug")).where((F.col("family") != "") & ~F.col("_slug").isin(NO_TOWN) & (F.col("_slug").contains("-") | (F.octet_length("_slug") >= 4)))
    size = towns.unionByName(linked).distinct().groupBy("family").agg(F.count(F.lit(1)).alias("estimated_cardinality"))
    m = g.join(size, "family", "left")
    if predicted is not None:
        dynamic = predicted.where(F.col("pattern").contains(":") | F.col("pattern").contains("*")).select(F.col("pattern").alias("family")).distinct()
        m = m.unionByName(dynamic.join(g.select("family"), "family", "left_anti"), allowMissingColumns=True)
    n, u, i = (F.coalesce(c, F.lit(0)) for c in ("measured_urls", "n_unique", "n_indexable"))
    only = F.coalesce("_map_only", F.lit(False))
    thin = (i >= 2) & (u == 1)
    verdict = (
        F.when(n == 0, "UNMEASURED").when(i == 0, "NOINDEX_BY_DEFAULT").when(thin, "CONSOLIDATE").when((u >= 2) & ~only, "SAFE_IF_REQUIREMENTS_MET").when(only, "REVIEW").when(u == 1, "SAFE_IF_REQUIREMENTS_MET").otherwise("UNMEASURED")
    )
    state = lambda cond: F.when(n == 0, "unmeasured").when(cond, "passed").otherwise("failed")
    open_ = F.lit("unmeasured")
    gates = {
        "sample_diversity": state(u >= 2), "canonical_strategy": F.when(i == 0, "unmeasured").otherwise(state(F.col("n_canonical") == i)), "discovery_support": state(~only), "internal_link_support": state(~only),
        "cannibalization_risk": F.when(n == 0, "unmeasured").when(thin, "failed").when(u >= 2, "passed").otherwise("unmeasured"),
    }
    return m.select(
        "family", n.alias("measured_urls"), i.alias("n_indexable"), u.alias("n_unique"), "estimated_cardinality", _share(n, F.col("estimated_cardinality")).alias("measured_sample_rate"), _share(F.col("n_canonical"), i).alias("canonical_coverage"),
        F.when(n > 0, F.when(only, 0).otherwise(100)).alias("internal_discovery"), F.when(n > 0, 100 - F.floor(u * 100 / F.greatest(n, F.lit(1)))).cast("int").alias("cannibalization_risk"), F.when(u >= 2, F.floor(u * 100 / n)).cast("int").alias("semantic_distinctness"),
        verdict.alias("verdict"), F.create_map(*[x for k in GATES for x in (F.lit(k), gates.get(k, open_))]).alias("gates"), "first_page",
    )


def _met(m: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Matrices with the rows of another table of families: equal names, or names that a matrix's own one contains by its last segments.

    Every tail and head of a family's path is a key, so families meet by equality instead of all with all; the first name wins.
    """
    s = F.split("family", "/")
    n = F.size(s)
    names = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(s, i, j - i + 1), "/"))))
    keyed = m.select("family", F.explode(F.array_distinct(names)).alias("_name"))
    best = keyed.join(other, keyed["_name"] == other[key]).groupBy(keyed["family"].alias("_family")).agg(F.min(F.struct(F.when(F.col("_name") == keyed["family"], 0).otherwise(1).alias("_far"), *[other[c].alias(c) for c in other.columns])).alias("_o"))
    return m.join(best, m["family"] == best["_family"], "left").drop("_family")


def enrich(m: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds what content.family_shares() measured, decides the gates that wait for it, and promotes a family whose four required gates
    pass to SAFE_TO_GENERATE. Shares: facts from 40 %, own facts from 15 %."""
    j = _met(m, shares, "family")
    v = lambda c: F.col(f"_o.{c}")
    seen = F.col("_o").isNotNull()
    floor = lambda c, least: F.when(~seen, F.lit("unmeasured")).when(v(c) >= least, "passed").when(v(c).isNotNull(), "failed").otherwise("unmeasured")
    doorway = F.when((v("template_shared_ratio") >= 70) & (v("unique_fact_ratio") < 15), 80).when(v("template_shared_ratio") >= 70, 55).when(v("unique_fact_ratio") >= 15, 20)
    distinct = F.when(v("unique_semantic_ratio").isNotNull(), F.least(v("unique_semantic_ratio") + F.coalesce(v("unique_fact_ratio"), F.lit(0)), F.lit(100))).otherwise(F.col("semantic_distinctness"))
    gates = F.map_concat(F.map_filter("gates", lambda k, _: ~k.isin("fact_coverage", "semantic_distinctness", "conversion_readiness", "doorway_risk")), F.create_map(
        F.lit("fact_coverage"), floor("local_fact_coverage", 40), F.lit("semantic_distinctness"), floor("unique_fact_ratio", 15), F.lit("conversion_readiness"), floor("schema_fact_coverage", 40),
        F.lit("doorway_risk"), F.when(doorway >= 70, "failed").when(doorway.isNotNull(), "passed").otherwise("unmeasured"),
    ))
    e = j.select(*[c for c in m.columns if c not in ("gates", "semantic_distinctness", "verdict")], "verdict", v("local_fact_coverage").alias("fact_coverage"), v("unique_fact_ratio").alias("unique_fact_ratio"), v("template_shared_ratio").alias("boilerplate_ratio"), distinct.cast("int").alias("semantic_distinctness"), v("schema_fact_coverage").alias("schema_fact_coverage"), doorway.alias("doorway_risk"), gates.alias("gates"))
    passed = (F.col("verdict") == "SAFE_IF_REQUIREMENTS_MET") & (F.col("measured_urls") >= 2)
    for k in REQUIRED:
        passed = passed & (F.col("gates")[k] == "passed")
    return e.withColumn("verdict", F.when(passed, "SAFE_TO_GENERATE").otherwise(F.col("verdict")))


def annotate(m: DataFrame, demand: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds ``demand_coverage`` and ``claim_integrity`` with their gates. ``demand`` is family, gsc_clicks, gsc_impressions;
    ``claims`` are claim findings with family names as ``subject_family``. Without any claim finding integrity is unmeasured."""
    j = _met(m, demand.withColumnRenamed("family", "_d"), "_d")
    seen = F.col("_o.gsc_impressions")
    hits = claims.groupBy(F.col("subject_family").alias("_family")).agg(F.count(F.lit(1)).alias("_hits"))
    ran = not claims.isEmpty()
    k = j.join(hits, j["family"] == hits["_family"], "left")
    count = F.coalesce("_hits", F.lit(0))
    integrity = F.when(F.lit(ran), F.greatest(100 - 20 * count, F.lit(0))).cast("int")
    states = F.create_map(F.lit("demand_evidence"), F.when(seen > 0, "passed").when(seen.isNotNull(), "failed").otherwise("unmeasured"), F.lit("claim_integrity"), F.when(~F.lit(ran), "unmeasured").when(count == 0, "passed").otherwise("failed"))
    return k.select(*[c for c in m.columns if c != "gates"], F.when(seen > 0, 100).when(seen.isNotNull(), 0).alias("demand_coverage"), integrity.alias("claim_integrity"), F.col("_o.gsc_clicks").alias("gsc_clicks"), seen.alias("gsc_impressions"), F.map_concat(F.map_filter("gates", lambda g, _: ~g.isin("demand_evidence", "claim_integrity")), states).alias("gates"))


def unmet(gates: Column) -> Column:
    """Labels of the gates that keep a family from being generated: failed ones, and required ones that are unmeasured."""
    blocks = lambda k: (gates[k] == "failed") | ((gates[k] == "unmeasured") & F.lit(k in REQUIRED))
    return F.filter(F.array(*[F.when(blocks(k), F.lit(label)) for k, label in GATES.items()]), lambda x: x.isNotNull())
