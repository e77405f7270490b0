"""How the shape of a site differs from that of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..functions.urls import archetypes, path_prefix, schema_archetype, segments


def instance_prefix(prefix: Column) -> Column:
    """A prefix whose second segment is a number or a long hexadecimal id: one item, no family."""
    second = F.try_element_at(segments(prefix), F.lit(2))
    return F.coalesce((F.size(segments(prefix)) == 2) & second.rlike("^([0-9]+|[0-9A-Fa-f]{8,})$"), F.lit(False))


def shapes(p: DataFrame, site: str = "_host") -> DataFrame:
    """``site, trait, value, n``: archetypes, prefixes, schema types and locales of each site with the times
    each occurs, as rows; a heading that speaks of a faq adds that archetype without counting."""
    path = ascii_lower(F.col("_path"))
    types = F.coalesce(F.flatten(F.transform("json_ld", lambda b: b["types"])), F.array().cast("array<string>"))
    row = lambda trait, n: lambda v: F.struct(F.lit(trait).alias("trait"), v.alias("value"), F.lit(n).alias("n"))
    faq = F.coalesce(F.exists("headings", lambda h: ascii_lower(h["text"]).contains("faq")), F.lit(False))
    alternates = F.coalesce(F.transform("alternates", lambda a: a["hreflang"]), F.array().cast("array<string>"))
    rows = F.concat(
        F.transform(archetypes(path), row("archetype", 1)), F.transform(F.filter(F.transform(types, schema_archetype), lambda t: t.isNotNull()), row("archetype", 1)),
        F.when(faq, F.array(row("archetype", 0)(F.lit("faq")))).otherwise(F.filter(F.array(row("archetype", 0)(F.lit("faq"))), lambda x: F.lit(False))),
        F.transform(F.filter(F.array(path_prefix(path)), lambda x: x.isNotNull()), row("prefix", 1)), F.transform(types, row("schema", 1)),
        F.transform(F.filter(F.concat(F.array(F.col("html_lang")), alternates), lambda x: x.isNotNull()), lambda v: row("locale", 1)(ascii_lower(v))),
    )
    return p.select(F.col(site).alias("site"), F.explode(rows).alias("r")).select("site", "r.*").groupBy("site", "trait", "value").agg(F.sum("n").alias("n"))


def totals(p: DataFrame, edges: DataFrame, site: str = "_host") -> DataFrame:
    """``site, indexable, with_h1, links``: counts of each site; ``edges`` has its site as ``site``."""
    h1 = F.coalesce(F.exists("headings", lambda h: h["level"] == 1), F.lit(False))
    counts = p.groupBy(F.col(site).alias("site")).agg(F.count_if("_ok").alias("indexable"), F.count_if(F.col("_ok") & h1).alias("with_h1"))
    return counts.join(edges.groupBy("site").agg(F.count(F.lit(1)).alias("links")), "site", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def gaps(shape: DataFrame, total: DataFrame, owned: str) -> DataFrame:
    """``kind, subject``: what other sites have and the owned one lacks.

    Archetypes (each for the first site by name that has it), prefixes (without blogs, categories and single items) and
    locales per site, schema types once, archetypes with four pages and more than twice the owned ones plus two, sites with eight
    links and more than twice the owned ones, and sites whose pages mostly have an h1 where most owned ones have none. Without
    another site one row says that nothing was compared.
    """
    ours = shape.where(F.col("site") == owned).select("trait", "value", F.col("n").alias("_own"), F.lit(True).alias("_has"))
    theirs = shape.where(F.col("site") != owned).join(ours, ["trait", "value"], "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    new = theirs.where("_has IS NULL")
    trait = F.col("trait")
    name = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    of = lambda df, kind, subject: df.select(F.lit(kind).alias("kind"), subject.alias("subject"))
    site, value = F.col("site"), F.col("value")
    kinds = new.where(trait == "archetype").groupBy("value").agg(F.min("site").alias("site"))
    prefix = new.where((trait == "prefix") & ~value.contains("/blog/") & ~value.contains("/category/") & ~instance_prefix(value))
    many = theirs.where((trait == "archetype") & (F.col("n") >= 4) & (F.col("n") > F.col("_own") * 2 + 2))
    out = of(kinds, "cluster_gap", name(site, ":", value)).unionByName(of(prefix, "cluster_gap", name(site, ":prefix:", value))).unionByName(of(new.where(trait == "locale"), "market_gap", name(site, ":locale:", value)))
    out = out.unionByName(of(new.where(trait == "schema").select("value").distinct(), "schema_gap", value)).unionByName(of(many, "cluster_gap", name(site, ":", value, ":cardinality")))
    own = total.where(F.col("site") == owned).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(f"_{c}") for c in ("indexable", "with_h1", "links")]).first()  # one row
    others = total.where(F.col("site") != owned)
    out = out.unionByName(of(others.where((F.col("links") > 2 * own["_links"]) & (F.col("links") >= 8)), "link_gap", site))
    if own["_indexable"] > 0 and own["_with_h1"] * 2 < own["_indexable"]:
        out = out.unionByName(of(others.where((F.col("indexable") > 0) & (F.col("with_h1") * 2 > F.col("indexable"))), "content_gap", site))
    alone = total.sparkSession.createDataFrame([("cluster_gap", "compare")], "kind string, subject string")
    return out if not others.isEmpty() else out.unionByName(alone)


def capabilities(**tables: DataFrame | None) -> list[tuple[str, bool]]:
    """(artefact, present) of a report: whether each table that is given holds a row."""
    return [(name, df is not None and not df.isEmpty()) for name, df in tables.items()]
