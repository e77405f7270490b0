"""What is fetched next: seeds from evidence, the strongest source of each URL, and the lanes of the frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import FAMILY_LOCALES, canonical_url, segments, url_parts, url_path
from .common import ranked

# Sources from weak to strong, and kinds of observations that name a URL worth fetching.
STRENGTH = {"sitemap": 0, "internal_link": 1, "previous_snapshot": 2, "ai_citation": 3, "log": 4, "gsc": 5, "explicit": 6}
KINDS = {"search_performance": "gsc", "bot_crawl": "log", "ai_citation": "ai_citation", "ai_referral": "ai_citation", "ai_prompt": "ai_citation"}
SAMPLES = 2  # pages of one town family that are urgent


def strength(source: Column) -> Column:
    """Rank of a source; null for unknown ones."""
    out = F.lit(None).cast("int")
    for name, rank in STRENGTH.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def strongest(found: DataFrame) -> DataFrame:
    """``host, url, source``: each URL (url, source) once, with its strongest source."""
    u = canonical_url(F.col("url"))
    g = found.select(u.alias("url"), "source", strength(F.col("source")).alias("_r")).where("url IS NOT NULL AND _r IS NOT NULL").groupBy("url").agg(F.max_by("source", "_r").alias("source"))
    return g.select(url_parts(F.col("url"))["host"].alias("host"), "url", "source")


def directed_seeds(observations: DataFrame, pages: DataFrame, host: str | None = None) -> DataFrame:
    """URLs of searches, logs, citations and earlier snapshots, of one host or all."""
    source = F.lit(None).cast("string")
    for k, v in KINDS.items():
        source = F.when(F.col("kind") == k, v).otherwise(source)
    found = observations.where("url IS NOT NULL").select("url", source.alias("source")).where("source IS NOT NULL").unionByName(pages.where("url IS NOT NULL").select("url", F.lit("previous_snapshot").alias("source")))
    out = strongest(found.distinct())
    return out if host is None else out.where(F.col("host") == host)


def town_family(path: Column) -> Column:
    """Family of a town page [locale]/(category|services)/slug/town whose town has a hyphen, else null."""
    s = segments(path)
    rest = F.when(F.try_element_at(s, F.lit(1)).isin(FAMILY_LOCALES), F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))).otherwise(s)
    at = lambda i: F.try_element_at(rest, F.lit(i))
    return F.when((F.size(rest) == 3) & at(1).isin("category", "services") & at(3).contains("-"), F.concat(F.lit("category/"), at(2)))


def frontier(urls: DataFrame, landings: DataFrame) -> DataFrame:
    """``host, lane, place, url, source``: urgent before linked before sitemap.

    Urgent are seeds from evidence, landing pages (their only segment, after a locale, is in ``landings``) and up to SAMPLES pages of each
    town family. Inside a lane stronger sources come first, then the URL. A batch takes the first places of one lane of a host.
    """
    path = url_path(F.col("url"))
    s = segments(path)
    rest = F.when(F.try_element_at(s, F.lit(1)).isin(FAMILY_LOCALES), F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))).otherwise(s)
    u = urls.withColumns({"_f": town_family(path), "_land": F.when(F.size(rest) == 1, F.try_element_at(rest, F.lit(1)))}).join(landings.select(F.col("landing").alias("_land"), F.lit(True).alias("_is")).distinct(), "_land", "left")
    sampled = F.when(F.col("_f").isNotNull(), F.row_number().over(Window.partitionBy("host", F.coalesce("_f", F.col("url"))).orderBy("url")))
    urgent = (sampled <= SAMPLES) | F.col("_is") | F.col("source").isin("gsc", "log", "ai_citation", "explicit")
    lane = F.when(F.coalesce(urgent, F.lit(False)), "urgent").when(F.col("source") == "sitemap", "sitemap").otherwise("linked")
    waiting = u.select("host", lane.alias("lane"), "url", "source")
    return ranked(waiting, [F.desc(strength(F.col("source"))), F.asc("url")], "place", ("host", "lane")).select("host", "lane", "place", "url", "source")


def next_batch(queue: DataFrame, workers: int) -> DataFrame:
    """The first ``workers`` URLs of each host's first lane that isn't empty."""
    order = F.when(F.col("lane") == "urgent", 0).when(F.col("lane") == "linked", 1).otherwise(2)
    first = queue.groupBy("host").agg(F.min(order).alias("_first"))
    return queue.join(first, "host").where((order == F.col("_first")) & (F.col("place") <= workers)).drop("_first")
