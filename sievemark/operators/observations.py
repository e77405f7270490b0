"""Roll-ups and rules over provider observations.

Rows have ``kind, query, url, provider, clicks, impressions, hits, position, period, bot_role,
status``; null counts mean 0. Every rule gives DataFrames; what wasn't measured stays null.
Provider rows meet pages by URL without closing slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import demand, expected_ctr, expected_value, percent_delta, position_gap, recoverable_clicks
from ..functions.urls import url_family, without_slashes
from .common import latest

SEARCH, BOT, CITATION, REFERRAL = "search_performance", "bot_crawl", "ai_citation", "ai_referral"
# Spellings of kinds, and kinds that a provider's name implies.
KINDS = {
    "search_performance": SEARCH, "search": SEARCH, "bot_crawl": BOT, "bot": BOT, "crawl": BOT, "ai_citation": CITATION, "ai": CITATION,
    "ai_prompt": "ai_prompt", "prompt": "ai_prompt", "ai_visibility": "ai_prompt", "ai_referral": REFERRAL, "ai_click": REFERRAL, "referral": REFERRAL,
    "serp_position": "serp_position", "serp": "serp_position", "keyword_volume": "keyword_volume", "keyword": "keyword_volume", "keywords": "keyword_volume", "search_volume": "keyword_volume",
    "backlink": "backlink", "backlinks": "backlink", "serp_feature": "serp_feature", "paa": "serp_feature", "ai_overview": "serp_feature", "analytics": "analytics",
}
PROVIDER_KINDS = {
    SEARCH: ["gsc", "search-console", "bing", "yandex"], BOT: ["logs", "cdn", "bot-logs", "nginx", "apache", "cloudflare", "fastly", "vercel"],
    CITATION: ["chatgpt", "perplexity", "gemini", "copilot", "ai-search"], "ai_prompt": ["semrush-ai", "ai-visibility", "prompt"], REFERRAL: ["chatgpt-user", "claude-user", "ai-referral"],
    "serp_position": ["serp", "serpapi", "serpstat"], "keyword_volume": ["semrush", "ahrefs", "dataforseo", "keywords", "keyword", "moz"], "backlink": ["backlinks", "backlink", "majestic"],
    "serp_feature": ["paa", "serp-features"],
}


def period_bucket(period: Column) -> Column:
    """previous, yoy or current by the words of a period text; null is current."""
    p = F.lower(period)
    return F.when(p.contains("prev") | p.contains("prior") | p.contains("before"), "previous").when(p.contains("yoy") | p.contains("year"), "yoy").otherwise("current")


def parse_kind(name: Column) -> Column:
    """The kind that a name spells, else null."""
    low, out = F.replace(F.lower(name), F.lit("-"), F.lit("_")), F.lit(None).cast("string")
    for k, v in KINDS.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def provider_kind(provider: Column) -> Column:
    """The kind that a provider's name implies; analytics for any other."""
    out = F.lit("analytics")
    for k, names in PROVIDER_KINDS.items():
        out = F.when(provider.isin(names), k).otherwise(out)
    return out


def current_rows(observations: DataFrame, *more: str) -> DataFrame:
    """The latest version of each row, counts without nulls; ties by the row's values. ``more`` columns come along."""
    cols = ["kind", "query", "url", "provider", "clicks", "impressions", "hits", "position", "period", "user_agent", "status", "bot_role"]
    lists = {f.name for f in observations.schema.fields if f.dataType.typeName() == "array"}
    ties = {f"_tie_{c}": F.array_join(c, "|") if c in lists else F.col(c) for c in more}
    versions = observations.select("row_id", "loaded_at", *cols, *more, *[v.alias(k) for k, v in ties.items()])
    rows = latest(versions, ["row_id"], F.col("loaded_at"), [*cols, *ties]).drop(*ties)
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("clicks", "impressions", "hits")})


def url_metrics(rows: DataFrame) -> DataFrame:
    """Clicks, impressions and citations per URL; null where nothing of the kind was seen."""
    search = F.col("kind") == SEARCH
    return rows.where("url IS NOT NULL").groupBy("url").agg(
        F.sum(F.when(search, F.col("clicks"))).alias("gsc_clicks"), F.sum(F.when(search, F.col("impressions"))).alias("gsc_impressions"), F.nullif(F.count_if(F.col("kind") == CITATION), F.lit(0)).alias("citations")
    )


def demand_axes(rows: DataFrame) -> DataFrame:
    """Demand and visibility gap per page URL; null without impressions and position."""
    best = F.min(F.when(F.col("position") > 0, F.col("position")))
    g = rows.where(F.col("kind") == SEARCH).where("url IS NOT NULL").groupBy(without_slashes(F.col("url")).alias("page_url")).agg(F.sum("impressions").alias("impressions"), best.alias("best"))
    seen = (F.col("impressions") > 0) | F.col("best").isNotNull()
    return g.select("page_url", F.when(seen, demand(F.col("impressions"))).alias("demand"), F.when(seen, position_gap(F.col("best").cast("double"))).alias("visibility_gap"))


def _current(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("kind") == SEARCH) & (period_bucket(F.col("period")) == "current"))


def ctr_gaps(rows: DataFrame) -> DataFrame:
    """Rows of 50 impressions whose clicks fall at least 5 short of the expected curve."""
    lost = recoverable_clicks(F.col("impressions"), F.col("clicks"), F.col("position"))
    return _current(rows).where("impressions >= 50 AND position IS NOT NULL").withColumn("recoverable", lost).where("recoverable >= 5").select(
        "row_id", F.coalesce("query", "url").alias("subject"), "url", "clicks", "impressions", F.round(expected_ctr(F.col("position")) * 100).cast("int").alias("expected_ctr_pct"), "recoverable",
        expected_value(F.col("recoverable"), F.lit(None).cast("int"), F.lit(55), F.lit(None).cast("int")).alias("expected_value"),
    )


def striking_distance(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of 50 impressions on measured pages at positions from 4 to below 20."""
    near = _current(rows).where("impressions >= 50 AND position >= 4 AND position < 20").withColumn("page_url", without_slashes(F.col("url")))
    return near.join(_measured(pages), "page_url", "left_semi").select("row_id", F.coalesce("query", F.lit("(unspecified query)")).alias("query"), "url", "impressions", "clicks")


def _measured(pages: DataFrame) -> DataFrame:
    return pages.select(without_slashes(F.col("url")).alias("page_url")).distinct()


def decay(rows: DataFrame) -> DataFrame:
    """URLs with at least 10 clicks before that lost 30 % or more of them."""
    bucket = period_bucket(F.col("period"))
    sums = rows.where(F.col("kind") == SEARCH).where("url IS NOT NULL").groupBy("url").agg(
        F.sum(F.when(bucket == "previous", F.col("clicks"))).alias("clicks_before"), F.coalesce(F.sum(F.when(bucket == "current", F.col("clicks"))), F.lit(0)).alias("clicks_after")
    )
    fell = F.floor(F.greatest(F.col("clicks_before") - F.col("clicks_after"), F.lit(0)) * 100 / F.col("clicks_before"))
    return sums.where("clicks_before >= 10").where(fell >= 30).withColumn("delta_pct", percent_delta(F.col("clicks_after"), F.col("clicks_before")))


def query_cannibalization(rows: DataFrame) -> DataFrame:
    """Queries that two or more URLs collect impressions for, a row per query and URL: consolidate
    within a family, else differentiate. Each URL counts with its first row."""
    asked = _current(rows).where("impressions >= 50 AND octet_length(query) > 3 AND url IS NOT NULL")
    first = asked.groupBy("query", without_slashes(F.col("url")).alias("page_url")).agg(F.min_by(F.struct("url", "clicks"), "row_id").alias("r"))
    g = first.groupBy("query").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("r.clicks").alias("clicks"), F.countDistinct(url_family(F.col("r.url"))).alias("_f")).where("n_urls >= 2 AND clicks >= 10")
    return first.join(g, "query").select("query", "page_url", "n_urls", "clicks", F.when(F.col("_f") == 1, "CONSOLIDATE").otherwise("DIFFERENTIATE").alias("action"))


def demand_without_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Search rows of 50 impressions on URLs that weren't crawled."""
    asked = rows.where(F.col("kind") == SEARCH).where("impressions >= 50 AND url IS NOT NULL").withColumn("page_url", without_slashes(F.col("url")))
    return asked.join(_measured(pages), "page_url", "left_anti").select("row_id", "url", "impressions")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.where("url IS NOT NULL").groupBy(without_slashes(F.col("url")).alias("page_url")).agg(
        F.sum(F.when(F.col("kind") == BOT, F.col("hits")).otherwise(0)).alias("_hits"), F.sum(F.when(F.col("kind") == SEARCH, F.col("impressions")).otherwise(0)).alias("_impressions")
    )


def demand_without_bots(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Search rows of 50 impressions on crawled URLs that no bot visits."""
    asked = rows.where(F.col("kind") == SEARCH).where("impressions >= 50 AND url IS NOT NULL").withColumn("page_url", without_slashes(F.col("url")))
    quiet = _sums(rows).where("_hits = 0").select("page_url")
    return asked.join(quiet, "page_url", "left_semi").join(_measured(pages), "page_url", "left_semi").select("row_id", "url", "impressions")


def bot_findings(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Bot rows on errors (7), non-indexable pages (8), pages without demand (9), orphans (10).

    ``pages`` has url, indexable and inbound; all rules are one left join on per-URL facts."""
    facts = pages.groupBy(without_slashes(F.col("url")).alias("page_url")).agg(
        F.bool_or(F.col("indexable") != "indexable").alias("_closed"), F.bool_or((F.col("indexable") == "indexable") & (F.col("inbound") == 0) & ~F.col("url").rlike("^[^:]+://[^/?#]*/?$")).alias("_orphan")
    )
    bots = rows.where(F.col("kind") == BOT).where("hits > 0 AND url IS NOT NULL").withColumn("page_url", without_slashes(F.col("url")))
    j = bots.join(facts, "page_url", "left").join(_sums(rows).select("page_url", "_impressions"), "page_url", "left")
    codes = F.array(
        F.when(F.col("status") >= 400, "SE-OBS-007"), F.when(F.col("_closed"), "SE-OBS-008"),
        F.when((F.col("hits") >= 20) & (F.col("_impressions") == 0) & F.col("_closed").isNotNull(), "SE-OBS-009"), F.when(F.col("_orphan"), "SE-OBS-010"),
    )
    return j.select("row_id", "url", "hits", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def ai_funnel(rows: DataFrame) -> DataFrame:
    """Discovery, citations and referrals per URL with floor-percent rates."""
    role, kind = F.col("bot_role"), F.col("kind")
    bot_hits = F.greatest(F.col("hits"), F.lit(1))
    found = F.sum(F.when((kind == BOT) & (role == "search_discovery"), bot_hits).otherwise(0))
    cited = F.sum(F.when((kind == BOT) & (role == "citation_fetch"), bot_hits).when(kind == CITATION, 1).otherwise(0))
    sent = F.sum(F.when(kind == REFERRAL, F.greatest(F.col("hits"), F.col("clicks"), F.lit(1))).otherwise(0))
    g = rows.where("url IS NOT NULL").groupBy("url").agg(found.alias("d"), cited.alias("c"), sent.alias("r")).where("d > 0 OR c > 0 OR r > 0")
    rate = lambda a, b: F.when(F.col(b) > 0, F.least(F.floor(F.col(a) * 100 / F.col(b)), F.lit(100)).cast("int"))
    return g.select(
        "url", *[F.nullif(F.col(c), F.lit(0)).alias(n) for c, n in (("d", "discovery_hits"), ("c", "citation_hits"), ("r", "referrals"))],
        rate("c", "d").alias("citation_rate"), rate("r", "c").alias("click_through"), ((F.col("d") >= 5) & (F.col("c") == 0)).alias("uncited"),
    )


def outcome_metrics(rows: DataFrame) -> DataFrame:
    """Global outcome numbers, one row per metric; value null where unmeasured."""
    cite, search = F.col("kind") == CITATION, F.col("kind") == SEARCH
    g = rows.agg(
        F.count_if(cite).alias("n"), F.countDistinct(F.when(cite, F.col("query"))).alias("q"), F.countDistinct(F.when(cite, F.col("url"))).alias("u"),
        F.count_if(search).alias("s"), F.sum(F.when(search, F.col("clicks"))).alias("k"), F.sum(F.when(search, F.col("impressions"))).alias("i"),
    )
    some = lambda c: F.when(F.col("n") > 0, F.col(c))
    none = F.lit(None).cast("long")
    metrics = [("citation_rate", some("n"), some("n"), none), ("mention_rate", some("n"), some("n"), none), ("prompts_observed", some("q"), some("q"), none), ("cited_urls", some("u"), some("u"), none), ("share_of_voice", none, some("n"), none), ("search_clicks", F.when(F.col("s") > 0, F.col("k")), F.when(F.col("s") > 0, F.col("k")), F.when(F.col("s") > 0, F.col("i")))]
    return g.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), a.alias("numerator"), b.alias("denominator")) for n, v, a, b in metrics])).alias("m")).select("m.*")


def citation_drops(rows: DataFrame) -> DataFrame:
    """Prompts whose URL was cited in the previous window and isn't in the current one."""
    cited = rows.where(F.col("kind") == CITATION).where("query IS NOT NULL AND url IS NOT NULL").select("query", "url", period_bucket(F.col("period")).alias("b"))
    before, now = cited.where("b = 'previous'").select("query", "url").distinct(), cited.where("b = 'current'").select("query", "url").distinct()
    return before.join(now, ["query", "url"], "left_anti").join(now.select("query").distinct(), "query", "left_semi")
