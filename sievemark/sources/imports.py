"""Observation imports: JSON files with rows, keywords, serp, backlinks, prompts and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..operators.observations import BOT, parse_kind, provider_kind

RECORD = (
    "struct<query:string,url:string,clicks:bigint,impressions:bigint,hits:bigint,position:float,provider:string,kind:string,period:string,user_agent:string,status:int,referer:string,"
    "volume:bigint,search_volume:bigint,difficulty:int,keyword_difficulty:int,features:array<string>,referring_domains:bigint,source_url:string,backlinks:bigint>"
)
PROMPT = "struct<prompt:string,platform:string,location:string,language:string,brand_mentioned:boolean,brand_position:int,cited_urls:array<string>,competitors:array<string>,observed_at:string,period:string>"
FILE = f"provider string, kind string, origin string, format string, log string, lines array<string>, rows array<{RECORD}>, keywords array<{RECORD}>, serp array<{RECORD}>, backlinks array<{RECORD}>, prompts array<{PROMPT}>, _corrupt string"
_LINE = '^(\\S+) \\S+ \\S+ \\[[^\\]]*\\] "(?:[A-Z]+ )?(\\S+)[^"]*" ([0-9]{3}) .*'


def read_imports(spark: SparkSession, path: str) -> DataFrame:
    """Import files as rows with ``input_state`` connected, empty or invalid.

    A file that isn't JSON of this shape is invalid, not absent; a byte order mark is ignored.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    parsed = text.select(F.from_json("value", FILE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("f")).select("f.*")
    some = F.lit(False)
    for b in ("rows", "keywords", "serp", "backlinks", "prompts", "lines"):
        some = some | F.coalesce(F.size(b) > 0, F.lit(False))
    return parsed.withColumn("input_state", F.when(F.col("_corrupt").isNotNull(), "invalid").when(some | F.col("log").isNotNull(), "connected").otherwise("empty")).drop("_corrupt")


def read_rendered(spark: SparkSession, path: str) -> DataFrame:
    """Rendered pages of JSON files: ``url, title, canonical, h1, description, json_ld_types, html_lang``; pages without a url are left out."""
    page = "struct<url:string,title:string,canonical:string,h1:string,description:string,json_ld_types:array<string>,html_lang:string>"
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return text.select(F.explode(F.from_json("value", f"pages array<{page}>")["pages"]).alias("p")).select("p.*").where("url IS NOT NULL")


def import_findings(files: DataFrame, label: str = "GSC") -> DataFrame:
    """OBS-003: import files that can't be read; files without rows are no findings. ``files`` has input_state."""
    bad = files.where("input_state = 'invalid'").limit(1)  # one finding, however many files
    return bad.select(F.lit("SE-OBS-003").alias("code"), F.lit("OBS").alias("family"), F.lit("error").alias("severity"), F.lit(f"{label}_INVALID").alias("url"), F.lit(label).alias("subject"))


def agent_of(user_agent: Column, agents: list[tuple[str, str]]) -> Column:
    """struct<token, role, verified> of a user agent: the two great search crawlers first, then the longest listed token that it
    contains, then any bot, spider or crawler; null for others. ``agents`` is the short list of (token, role), which travels inside the
    expression; for long lists map values to it by llm.canonical instead."""
    made = lambda token, role, sure: F.struct(token.alias("token"), role.alias("role"), sure.alias("verified"))
    ordered = sorted(agents, key=lambda a: (len(a[0]), a[0]), reverse=True)
    known = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(r).alias("role")) for t, r in ordered]) if ordered else F.array().cast("array<struct<token:string,role:string>>")

    def of(low: Column) -> Column:
        first = F.try_element_at(F.filter(known, lambda a: F.instr(low, a["token"]) > 0), F.lit(1))
        return (
            F.when(low.contains("googlebot") & ~low.contains("google-extended"), made(F.lit("googlebot"), F.lit("search_discovery"), low.contains("google.com/bot.html")))
            .when(low.contains("bingbot"), made(F.lit("bingbot"), F.lit("search_discovery"), low.contains("bing.com/bingbot"))).when(first.isNotNull(), made(first["token"], first["role"], F.lit(True)))
            .when(low.contains("bot") | low.contains("spider") | low.contains("crawler"), made(F.lit("unknown-bot"), F.lit("other"), F.lit(False)))
        )

    return F.transform(F.array(ascii_lower(user_agent)), of)[0]


def listed_agents(agents: DataFrame) -> list[tuple[str, str]]:
    """(token, role) of the list of crawlers, some dozens by nature."""
    return [(r["token"], r["role"]) for r in agents.select("token", "role").where("token IS NOT NULL").collect()]


def observations_of(files: DataFrame, agents: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """All observations of import files in one shape, but for log lines.

    Kind of a row: its own, else the file's, else what the provider's name implies; keywords, serp and
    backlinks have theirs unless the row says otherwise. A row of analytics whose user agent is a crawler's is a visit of it. Providers
    are in lower case, gsc if none is given. Impressions count for searches, volumes for keywords, hits for the rest: the larger of
    hits and impressions, for backlinks of backlinks too and at least one. A prompt gives one citation per cited
    URL, else one prompt row.
    """
    cols = ["query", "url", "position", "period", "user_agent", "status"]
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0).cast("bigint"))

    def branch(name: str, kind: str | None) -> DataFrame:
        r = files.select(F.col("provider").alias("_fp"), F.col("kind").alias("_fk"), F.explode(name).alias("r")).where("r IS NOT NULL")
        provider = F.lower(F.coalesce("r.provider", "_fp", F.lit("gsc")))
        bot = agent_of(F.col("r.user_agent"), agents) if kind is None else F.lit(None).cast("struct<token:string,role:string,verified:boolean>")
        r = r.withColumns({"_provider": provider, "_bot": bot})
        own = parse_kind(F.col("r.kind"))
        told = F.coalesce(own, parse_kind(F.col("_fk")), provider_kind(F.col("_provider"))) if kind is None else F.coalesce(own, F.lit(kind))
        r = r.withColumn("_kind", F.when((told == "analytics") & F.col("_bot").isNotNull(), BOT).otherwise(told))
        k = F.col("_kind")
        search, word = k == "search_performance", k == "keyword_volume"
        hits = F.when(search | word, F.lit(0).cast("bigint")).when(k == "backlink", F.greatest(zero("backlinks"), zero("hits"), zero("impressions"), F.lit(1).cast("bigint"))).otherwise(F.greatest(zero("hits"), zero("impressions")))
        volume = F.when(word, F.greatest(zero("volume"), zero("search_volume"), zero("impressions"))).otherwise(F.lit(0).cast("bigint"))
        return r.select(
            k.alias("kind"), *[F.col(f"r.{c}").alias(c) for c in cols], zero("clicks").alias("clicks"), F.when(search, zero("impressions")).otherwise(F.lit(0).cast("bigint")).alias("impressions"), hits.alias("hits"), F.coalesce("r.referer", "r.source_url").alias("referer"), F.col("_provider").alias("provider"),
            volume.alias("volume"), F.coalesce("r.difficulty", "r.keyword_difficulty").alias("difficulty"), F.col("r.features").alias("serp_features"), F.col("r.referring_domains").alias("referring_domains"), F.col("_bot.role").alias("bot_role"), F.col("_bot.verified").alias("verified_bot"),
        )

    prompts = files.select(F.lower(F.coalesce("provider", F.lit("gsc"))).alias("provider"), F.explode("prompts").alias("p")).where("p IS NOT NULL")
    cited = F.filter(F.coalesce("p.cited_urls", F.array().cast("array<string>")), lambda u: u.isNotNull())
    each = prompts.select("provider", "p", F.explode_outer(cited).alias("_u"))
    null = lambda t: F.lit(None).cast(t)
    no = F.lit(0).cast("bigint")
    has = F.col("_u").isNotNull()
    asked = each.select(
        F.when(has, "ai_citation").otherwise("ai_prompt").alias("kind"), F.col("p.prompt").alias("query"), F.coalesce("_u", F.concat(F.lit("prompt:"), F.coalesce("p.platform", F.lit("")))).alias("url"), F.col("p.brand_position").cast("float").alias("position"), F.col("p.period").alias("period"), null("string").alias("user_agent"), null("int").alias("status"),
        no.alias("clicks"), no.alias("impressions"), F.when(has, 1).otherwise(0).cast("bigint").alias("hits"), null("string").alias("referer"), "provider", no.alias("volume"), null("int").alias("difficulty"), null("array<string>").alias("serp_features"), null("bigint").alias("referring_domains"), null("string").alias("bot_role"), null("boolean").alias("verified_bot"),
    )
    return branch("rows", None).unionByName(branch("keywords", "keyword_volume")).unionByName(branch("serp", "serp_position")).unionByName(branch("backlinks", "backlink")).unionByName(asked)


def log_hits(files: DataFrame, agents: DataFrame) -> DataFrame:
    """Bot hits of combined access-log lines, rolled up by url, role and status.

    Lines are the file's ``lines`` and the lines of its ``log``. The last quoted text is the user agent; lines
    that can't be read and visitors that are no bots are dropped. ``agents`` is the short list of
    known crawlers (token, role).
    """
    lines = F.concat(F.coalesce("lines", F.array().cast("array<string>")), F.coalesce(F.split("log", "\\r?\\n"), F.array().cast("array<string>")))
    l = files.select("origin", F.explode(lines).alias("line")).where(F.col("line").rlike(_LINE) & ~F.col("line").startswith("#"))
    ua = F.regexp_extract("line", '"([^"]*)"\\s*$', 1)
    p = l.select("origin", F.regexp_extract("line", _LINE, 2).alias("path"), F.regexp_extract("line", _LINE, 3).cast("int").alias("status"), ascii_lower(ua).alias("ua"))
    role = agent_of(F.col("ua"), listed_agents(agents))["role"]
    url = F.when(F.col("path").rlike("^https?://"), F.col("path")).otherwise(F.concat(F.regexp_replace("origin", "/+$", ""), F.when(F.col("path").startswith("/"), "").otherwise("/"), F.col("path")))
    return p.select(url.alias("url"), role.alias("bot_role"), "status").where("bot_role IS NOT NULL").groupBy("url", "bot_role", "status").agg(F.count(F.lit(1)).alias("hits")).withColumn("kind", F.lit(BOT))
