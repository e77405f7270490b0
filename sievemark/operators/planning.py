"""Family matrices, opportunities, their rank, difficulty and the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import expected_ctr, expected_value, recoverable_clicks, trust_rank
from .common import ranked
from .snapshots import plain_hash

# What an opportunity's kind turns into, the stages of an action, those that only verify, and what a kind costs.
ACTIONS = {"link_gap": "LINK", "link_rec": "LINK", "cannibal": "CONSOLIDATE", "duplicate": "CONSOLIDATE", "create_family": "CREATE", "noindex": "NOINDEX", "delete": "DELETE"}
STAGES = {
    "CREATE": ["ADD_FACT", "BIND_ENTITY", "ADD_SCHEMA", "CRAWL", "OBSERVE_GSC"], "IMPROVE": ["UPDATE_CONTENT", "CRAWL", "DIFF", "OBSERVE_GSC"], "LINK": ["ADD_INTERNAL_LINKS", "CRAWL"],
    "CONSOLIDATE": ["PICK_CANONICAL", "CRAWL", "DIFF"], "NOINDEX": ["SET_NOINDEX", "CRAWL"], "DELETE": ["SET_NOINDEX", "CRAWL"],
}
VERIFYING = ["CRAWL", "OBSERVE_GSC", "DIFF"]
COSTS = {"create_family": 55, "cannibal": 50, "noindex": 25, "content_gap": 28, "sitemap_gap": 12, "link_gap": 18, "link_rec": 18}
OTHER_COST = 35


def _case(column: Column, table: dict, other: object) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def family_matrix(pages: DataFrame) -> DataFrame:
    """One row per route family of pages with status 200: cardinality, distinct contents, verdict."""
    p = pages.where("status = 200 AND family IS NOT NULL")
    idx = F.col("indexable") == "indexable"
    g = p.groupBy("family").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(idx).alias("n_indexable"), F.countDistinct(F.when(idx, plain_hash(F.col("content_hash")))).alias("n_unique"), F.count_if(F.col("inbound") == 0).alias("n_unlinked"), F.sum("gsc_clicks").alias("clicks"), F.sum("gsc_impressions").alias("impressions"))
    verdict = (
        F.when(F.col("n_indexable") == 0, "NOINDEX_BY_DEFAULT").when((F.col("n_indexable") >= 2) & (F.col("n_unique") == 1), "CONSOLIDATE").when((F.col("n_unique") >= 2) & (F.col("n_unlinked") < F.col("n_pages")), "SAFE_IF_REQUIREMENTS_MET")
        .when(F.col("n_unlinked") == F.col("n_pages"), "REVIEW").when(F.col("n_unique") == 1, "SAFE_IF_REQUIREMENTS_MET").otherwise("UNMEASURED")
    )
    return g.withColumn("verdict", verdict)


def opportunities(pages: DataFrame, matrix: DataFrame, axes: DataFrame) -> DataFrame:
    """``kind, subject, demand, visibility_gap, confidence, risk, leverage, cost``: what could be done.

    Orphans ask for links, untitled pages for content, families by their verdict; demand and gap come from
    ``axes`` (page_url) and stay null where unmeasured.
    """
    ok = pages.where("status = 200 AND indexable = 'indexable'")
    null = F.lit(None).cast("int")
    pick = lambda df, kind, c, conf, risk, cost: df.select(F.lit(kind).alias("kind"), F.col(c).alias("subject"), conf.alias("confidence"), risk.alias("risk"), F.lit(cost).alias("cost"))
    base = pick(ok.where((F.col("inbound") == 0) & ~F.col("url").rlike("^[^:]+://[^/?#]*/?$")), "link_gap", "url", F.lit(60), F.lit(10), 20)
    base = base.unionByName(pick(ok.where("title IS NULL"), "content_gap", "url", F.lit(50), null, 40))
    for verdict, kind, risk in (("CONSOLIDATE", "cannibal", 40), ("SAFE_IF_REQUIREMENTS_MET", "create_family", 30), ("NOINDEX_BY_DEFAULT", "noindex", 80)):
        base = base.unionByName(pick(matrix.where(F.col("verdict") == verdict), kind, "family", null, F.lit(risk), 60))
    key = F.regexp_replace("subject", "/+$", "")
    return base.withColumn("_k", key).join(axes.withColumnRenamed("page_url", "_k"), "_k", "left").drop("_k")


def rank_opportunities(items: DataFrame) -> DataFrame:
    """Adds ``trust`` and ``rank``, one order of all: trust, whether demand is measured, demand, gap, value, conversion, leverage,
    fit and cheapness, each descending with unmeasured as 0; ties by kind and subject. Axes that items lack are unmeasured."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in items.columns else F.lit(0)
    axes = ["demand", "visibility_gap", "business_value", "conversion_potential", "leverage", "topical_fit"]
    order = [F.desc("trust"), F.desc(F.col("demand").isNotNull()), *[F.desc(number(a)) for a in axes], F.asc(F.least(number("cost"), F.lit(100))), F.asc("kind"), F.asc("subject")]
    return ranked(items.withColumn("trust", trust_rank(F.col("confidence"), F.col("risk"))), order)


def plan_stages(items: DataFrame) -> DataFrame:
    """``kind, subject, action, stage_no, stage, requires, relation``: the steps of each opportunity's
    action. A step requires the one before it; crawls, observations and comparisons verify it."""
    action = _case(F.col("kind"), ACTIONS, "IMPROVE")
    stages = F.array(*map(F.lit, STAGES["IMPROVE"]))
    for a, names in STAGES.items():
        stages = F.when(F.col("action") == a, F.array(*map(F.lit, names))).otherwise(stages)
    s = items.select("kind", "subject", action.alias("action")).distinct().withColumn("_s", stages)
    relation = F.when(F.col("stage_no") > 0, F.when(F.col("stage").isin(VERIFYING), "VERIFY_AFTER").otherwise("REQUIRES"))
    return s.select("kind", "subject", "action", "_s", F.posexplode("_s").alias("stage_no", "stage")).select("kind", "subject", "action", "stage_no", "stage", F.try_element_at("_s", F.nullif(F.col("stage_no"), F.lit(0))).alias("requires"), relation.alias("relation"))


def plan_links(stages: DataFrame) -> DataFrame:
    """``subject, waits_for``: links whose subject is also created wait for the last step of its creation."""
    made = stages.where("action = 'CREATE'").groupBy("subject").agg(F.max_by("stage", "stage_no").alias("waits_for"))
    return stages.where("action = 'LINK' AND stage_no = 0").select("subject").distinct().join(made, "subject")


def base_opportunities(p: DataFrame, orphans: DataFrame, matrix: DataFrame) -> DataFrame:
    """``kind, subject, summary``: orphans (findings with a url), linked pages outside the sitemap, pages without
    an h1, and families by their verdict. Pages are rules.with_state()'s with ``_linked``."""
    ok = p.where("_ok")
    h1 = F.coalesce(F.exists("headings", lambda h: h["level"] == 1), F.lit(False))
    pick = lambda df, kind, c, tail: df.select(F.lit(kind).alias("kind"), F.col(c).alias("subject"), F.concat(F.col(c), F.lit(tail)).alias("summary"))
    out = pick(orphans, "link_gap", "url", " is indexable but has no internal inlinks from the seed").unionByName(pick(ok.where("NOT in_sitemap AND _linked"), "sitemap_gap", "_url", " is linked and indexable but absent from the sitemap"))
    out = out.unionByName(pick(ok.where(~h1), "content_gap", "_url", " has no H1"))
    made = (F.col("verdict") == "SAFE_IF_REQUIREMENTS_MET") | ((F.col("verdict") == "UNMEASURED") & F.col("family").contains(":"))
    for cond, kind, tail in ((F.col("verdict") == "CONSOLIDATE", "cannibal", " variants should be consolidated"), (made, "create_family", " needs unique facts before expansion"), (F.col("verdict") == "NOINDEX_BY_DEFAULT", "noindex", " should stay out of the index by default")):
        out = out.unionByName(pick(matrix.where(cond), kind, "family", tail))
    return out


def _phrases(text: Column) -> Column:
    """Runs of up to eight words of a text as they are written, lower case: what a query may equal."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    n = F.size(words)
    every = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(n, i + 7)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " ")))))
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def _words(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), " ")


def decorate(items: DataFrame, rows: DataFrame, axes: DataFrame, pages: DataFrame) -> DataFrame:
    """Opportunities with what was observed of them.

    ``rows`` are current observations, ``axes`` observations.demand_axes(), ``pages`` page_url, inbound and rank. Adds demand,
    visibility_gap, raw_impressions, raw_clicks, expected_ctr, recoverable_clicks, cost, leverage, difficulty_to_rank and expected_value. A market row belongs to
    an item if its URL is the subject or its query's words stand in the subject or the summary, one after the other.
    """
    item = items.withColumns({"_k": F.regexp_replace("subject", "/+$", ""), "_id": F.xxhash64("kind", "subject")})
    url = F.regexp_replace("url", "/+$", "")
    search = rows.where("kind = 'search_performance' AND url IS NOT NULL").groupBy(url.alias("_k")).agg(F.sum("impressions").alias("_i"), F.sum("clicks").alias("_c"), F.min("position").alias("_p"))
    market = rows.where("kind IN ('keyword_volume', 'serp_position', 'serp_feature')")
    boost = F.when(F.col("kind") == "serp_position", 8 + F.when(F.col("position") <= 3, 10).otherwise(0)).otherwise(0) + F.when(F.exists("serp_features", lambda f: f.contains("ai_overview") | (f == "paa")), 6).otherwise(0)
    facts = market.select("row_id", url.alias("_u"), _words(F.col("query")).alias("_q"), "difficulty", boost.alias("_b"))
    by_url = item.select("_id", "_k").join(facts.where("_u IS NOT NULL"), F.col("_k") == F.col("_u")).select("_id", "row_id", "difficulty", "_b")
    by_word = item.select("_id", F.explode(F.array_union(_phrases(F.col("subject")), _phrases(F.col("summary")))).alias("_w")).join(facts.where("_q <> ''"), F.col("_w") == F.col("_q")).select("_id", "row_id", "difficulty", "_b")
    seen = by_url.unionByName(by_word).dropDuplicates(["_id", "row_id"]).groupBy("_id").agg(F.max("difficulty").alias("_d"), F.sum("_b").alias("_b"))
    most = pages.agg(F.max("rank")).first()[0] or 0.0  # one number
    own = pages.select(F.regexp_replace("page_url", "/+$", "").alias("_k"), "inbound", "rank").groupBy("_k").agg(F.max("inbound").alias("_in"), F.max("rank").alias("_r"))
    j = item.join(search, "_k", "left").join(axes.withColumnRenamed("page_url", "_k"), "_k", "left").join(own, "_k", "left").join(seen, "_id", "left")
    shown = F.col("_i") > 0
    rate = expected_ctr(F.col("_p"))
    recoverable = F.when(shown, F.when(F.col("_p").isNotNull(), recoverable_clicks(F.col("_i"), F.col("_c"), F.col("_p"))).when(F.col("visibility_gap").isNotNull(), F.col("visibility_gap") * F.floor(F.greatest(F.col("_i"), F.lit(1)) / 100)))
    bonus = F.lit(0) if most <= 0 else F.least(F.greatest(F.round(30 * F.coalesce("_r", F.lit(0.0)) / most), F.lit(0.0)), F.lit(30.0))
    base = F.coalesce("_d", F.lit(40)) + F.least(F.coalesce("_b", F.lit(0)), F.when(F.col("_d").isNotNull(), 25).otherwise(40)) - bonus
    rank_ = F.when(F.col("_d").isNotNull() | (F.col("_b") > 0), F.least(F.greatest(base, F.lit(0)), F.lit(100)).cast("int"))
    leverage = F.when(F.col("_in") == 0, 80).when(F.col("_in") > 0, F.least(20 + 8 * F.col("_in"), F.lit(80))).when(F.col("kind").isin("link_gap", "link_rec"), 80).cast("int")
    out = j.select(
        *items.columns, "demand", "visibility_gap", F.when(shown, F.col("_i")).alias("raw_impressions"), F.when(shown, F.col("_c")).alias("raw_clicks"), F.when(shown & F.col("_p").isNotNull(), F.round(rate * 100)).cast("int").alias("expected_ctr"),
        recoverable.cast("long").alias("recoverable_clicks"), _case(F.col("kind"), COSTS, OTHER_COST).alias("cost"), leverage.alias("leverage"), rank_.alias("difficulty_to_rank"),
    )
    null = F.lit(None).cast("int")
    return out.withColumn("expected_value", F.when(F.col("recoverable_clicks").isNotNull(), expected_value(F.col("recoverable_clicks"), null, null, F.col("cost"))))


def difficulty_to_build(items: DataFrame, shares: DataFrame, produced: DataFrame) -> DataFrame:
    """Adds ``difficulty_to_build``: cost, risk by 5, missing own facts by 4, less coverage by 5, 12 and 8 for
    a producer of the family, and leverage by 5; 0 to 100.

    ``shares`` is content.family_shares(), met by the item's ``family``; ``produced`` has the families that sources produce.
    """
    f = shares.select(F.col("family").alias("_f"), "unique_fact_ratio", "local_fact_coverage")
    j = items.join(f, items["family"] == F.col("_f"), "left").join(produced.select(F.col("family").alias("_made")).distinct(), items["family"] == F.col("_made"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    risk = F.col("risk") if "risk" in items.columns else F.lit(None).cast("int")
    score = F.col("cost") + zero(F.floor(risk / 5)) + zero(F.floor((100 - F.col("unique_fact_ratio")) / 4)) - zero(F.floor(F.col("local_fact_coverage") / 5)) - F.when(F.col("_f").isNotNull() & F.col("_made").isNotNull(), 12).otherwise(0) - F.when(F.col("_made").isNotNull(), 8).otherwise(0) - zero(F.floor(F.col("leverage") / 5))
    return j.select(*items.columns, F.least(F.greatest(score, F.lit(0)), F.lit(100)).cast("int").alias("difficulty_to_build"))


def handoff(actions: DataFrame, producers: DataFrame) -> DataFrame:
    """``path, subject, action, hash``: the source that an action changes, each path and subject once.

    ``producers`` is family, path, hash; aliases and bare imports are no sources. An action's subject is a family or a page with ``family``.
    """
    own = producers.where(~F.col("path").startswith("@") & (F.col("path") != "import")).select("family", "path", "hash").distinct()
    j = actions.select("subject", "action", "family").distinct().join(own, "family")
    return j.groupBy("path", "subject").agg(F.min("action").alias("action"), F.min("hash").alias("hash"))


def stale_targets(targets: DataFrame, producers: DataFrame, planned: str | None = None, now: str | None = None) -> DataFrame:
    """``path, reason``: targets of a handoff that are gone from the sources, or whose hash changed; and the revision, if it did."""
    there = producers.groupBy("path").agg(F.min("hash").alias("_now"))
    j = targets.select("path", "hash").distinct().join(there, "path", "left")
    out = j.where(F.col("_now").isNull() | (F.col("_now") != F.col("hash"))).select("path", F.when(F.col("_now").isNull(), "gone").otherwise("hash changed").alias("reason")).distinct()
    if planned and now and planned != now:
        out = out.unionByName(targets.sparkSession.createDataFrame([(None, f"source changed ({planned} to {now})")], "path string, reason string"))
    return out
