"""Page rules: every rule reads an extracted-page table and gives findings.

Pages have ``url, status, media, canonical, robots, title, description, html_lang, alternates,
headings, links, images, json_ld, text, og_title, og_image, headers, csp_meta, body_bytes,
fetch_ms, has_main, unlabeled_controls, in_sitemap, redirects, ordinal``. Findings are
``code, family, severity, url, subject``. A signal that is null is unmeasured: it neither fires nor
passes a rule, unless the rule asks for its absence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..functions.urls import canonical_url, city_shaped, join_url, locale_of, query_value, segments, url_parts, url_path
from .common import ranked
from .graph import depths

# Bytes and milliseconds above which a page is heavy or slow, and types that publish.
BODY_LIMIT, FETCH_LIMIT = 524_288, 2_500
PUBLISHER_TYPES = ["organization", "website"]


# What a type must have, by feature: (number of the code, type, feature, groups of
# properties of which one each is needed). 2: a current rich result, 3: the vocabulary, 4: a retired rich result.
REQUIREMENTS = [
    (4, "FAQPage", "FAQ", [["mainEntity"]]), (2, "QAPage", "QAndA", [["mainEntity"]]), (2, "Offer", "MerchantListing", [["price", "priceSpecification"]]),
    (2, "Product", "Product", [["name"], ["review", "aggregateRating", "offers"]]), (2, "LocalBusiness", "LocalBusiness", [["name"], ["address"]]), (2, "Article", "Article", [["headline"]]),
    (4, "HowTo", "HowTo", [["name"], ["step"]]), (2, "BreadcrumbList", "Breadcrumb", [["itemListElement"]]), (3, "Organization", "Organization", [["name"]]),
]
_SEVERITY = {2: "warn", 3: "info", 4: "info"}


def with_state(pages: DataFrame) -> DataFrame:
    """Adds identity, indexability and the base predicate ``_ok`` (status 200 and indexable)."""
    noindex = F.exists(F.coalesce("robots", F.array().cast("array<string>")), lambda r: F.exists(F.split(r, ","), lambda t: F.lower(F.trim(t)) == "noindex"))
    p = pages.withColumns({"_url": F.coalesce(canonical_url(F.col("url")), F.col("url")), "_canon": join_url(F.col("url"), F.col("canonical"))})
    state = (
        F.when(F.col("status").between(300, 399), "redirected").when((F.col("status") >= 400) | (F.col("status") == 0), "error").when(noindex, "noindex")
        .when(F.col("_canon") != F.col("_url"), "canonicalized").otherwise("indexable")
    )
    p = p.withColumn("indexability", state)
    ok = (F.col("status") == 200) & (F.col("indexability") == "indexable")
    return p.withColumns({"_ok": ok, "_html": ok & (F.coalesce("media", F.lit("html")) == "html"), "_host": url_parts(F.col("_url"))["host"], "_path": url_path(F.col("_url"))})


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _finding(df: DataFrame, code: str, severity: str, subject: Column | None = None) -> DataFrame:
    return df.select(F.lit(f"SE-{code}").alias("code"), F.lit(code.split("-")[0]).alias("family"), F.lit(severity).alias("severity"), F.col("_url").alias("url"), (F.col("_url") if subject is None else subject).alias("subject"))


def page_local(p: DataFrame) -> DataFrame:
    """All rules that need one page only, in one pass: an array of codes is exploded."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    h1 = F.size(F.filter(F.coalesce("headings", F.array()), lambda h: h["level"] == 1)) if "headings" in p.columns else F.lit(1)
    https = F.col("_url").startswith("https://")
    content_images = F.filter(F.col("images"), lambda i: ~F.coalesce(i["hidden"], F.lit(False)))
    blocks = F.col("json_ld")
    heads = F.transform(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string>>")), lambda h: F.lower(h["text"]))
    faq_copy = F.exists(heads, lambda t: t.contains("faq") | t.contains("frequently asked")) | (F.size(F.filter(heads, lambda t: t.rlike("\\?\\s*$"))) >= 2)
    has_type = lambda names: F.coalesce(F.exists(blocks, lambda b: F.exists(b["types"], lambda t: F.lower(F.regexp_replace(t, "^.*/", "")).isin(names))), F.lit(False))
    rules = [
        ("CRAWL-001", "error", F.col("status").between(400, 499)), ("CRAWL-002", "error", F.col("status") >= 500), ("CRAWL-003", "warn", size("redirects") > 1),
        ("CANON-001", "warn", F.col("_html") & F.col("canonical").isNull()), ("SITEMAP-001", "error", F.col("in_sitemap") & (F.col("status") >= 400)), ("SITEMAP-002", "warn", F.col("in_sitemap") & (F.col("indexability") == "noindex")),
        ("META-001", "error", F.col("_html") & _blank("title")), ("META-003", "info", F.col("_html") & _blank("description")), ("META-004", "info", F.col("_html") & _blank("og_title")), ("META-005", "info", F.col("_html") & _blank("og_image")),
        ("SCHEMA-001", "warn", F.col("_ok") & F.coalesce(F.exists(blocks, lambda b: ~b["valid_json"]), F.lit(False))),
        ("CONTENT-001", "error", F.col("_html") & (h1 == 0)), ("CONTENT-002", "warn", F.col("_html") & (h1 > 1)),
        ("A11Y-001", "warn", F.col("_html") & _blank("html_lang")), ("A11Y-002", "warn", F.col("_html") & F.coalesce(F.exists(content_images, lambda i: i["alt"].isNull()), F.lit(False))), ("A11Y-004", "warn", F.col("_html") & ~F.col("has_main")),
        ("PERF-001", "warn", F.col("_ok") & (F.col("body_bytes") > BODY_LIMIT)), ("PERF-002", "warn", F.col("_ok") & (F.col("fetch_ms") > FETCH_LIMIT)),
        ("SEC-008", "warn", F.col("_html") & https & (F.coalesce(F.exists("images", lambda i: i["src"].startswith("http://")), F.lit(False)) | F.coalesce(F.col("og_image").startswith("http://"), F.lit(False)))),
        ("AI-002", "warn", F.col("_html") & faq_copy & ~has_type(["faqpage", "qapage", "question"])),
    ]
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(f"SE-{k}").alias("code"), F.lit(k.split("-")[0]).alias("family"), F.lit(s).alias("severity"))) for k, s, c in rules]), lambda x: x.isNotNull())
    return p.select(F.explode(hits).alias("h"), F.col("_url").alias("url")).select("h.code", "h.family", "h.severity", "url", F.col("url").alias("subject"))


def short_type(name: Column) -> Column:
    """A schema type without its address or prefix."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "^.*:", "")


def schema_gaps(p: DataFrame, requirements: list = REQUIREMENTS) -> DataFrame:
    """Typed nodes that lack what their type needs (SCHEMA-002, 003, 004), with the missing properties as subject.

    A group of properties is met by any of them, whatever the case; a dotted one by its parent too.
    """
    nodes = p.select("_url", F.explode("json_ld").alias("b")).where("b.valid_json").select("_url", F.explode("b.nodes").alias("n"))
    typed = nodes.select("_url", F.transform("n.properties", F.lower).alias("_p"), F.explode("n.types").alias("_t")).withColumn("_t", F.lower(short_type(F.col("_t"))))
    gaps = []
    for number, kind, feature, groups in requirements:
        met = [[x.lower() for name in g for x in ([name, name.rsplit(".", 1)[0]] if "." in name else [name])] for g in groups]
        lacks = F.concat(*[F.when(F.arrays_overlap("_p", F.array(*map(F.lit, m))), F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, g))) for g, m in zip(groups, met)])
        gaps.append(F.when((F.col("_t") == kind.lower()) & (F.size(lacks) > 0), F.struct(F.lit(f"SE-SCHEMA-00{number}").alias("code"), F.lit(_SEVERITY[number]).alias("severity"), F.concat(F.lit(f"{kind}/{feature}: "), F.array_join(lacks, " OR ")).alias("subject"))))
    hits = F.filter(F.array(*gaps), lambda x: x.isNotNull())
    return typed.select("_url", F.explode(hits).alias("h")).select("h.code", F.lit("SCHEMA").alias("family"), "h.severity", F.col("_url").alias("url"), "h.subject")


def canonical_targets(p: DataFrame) -> DataFrame:
    """Canonical to an error (2), to a page that canonicalises elsewhere (3), out of the crawl (4)."""
    t = p.select(F.col("_url").alias("_t"), F.col("status").alias("_ts"), F.col("_canon").alias("_tc")).dropDuplicates(["_t"])
    j = p.where((F.col("status") == 200) & F.col("_canon").isNotNull() & (F.col("_canon") != F.col("_url"))).join(t, F.col("_canon") == F.col("_t"), "left")
    away = (F.col("_ts") < 400) & (F.col("_tc") != F.col("_t")) & (F.col("_tc") != F.col("_url"))
    return _finding(j.where("_ts >= 400"), "CANON-002", "error").unionByName(_finding(j.where(away), "CANON-003", "warn")).unionByName(_finding(j.where("_t IS NULL"), "CANON-004", "info"))


def alternates(p: DataFrame) -> DataFrame:
    """hreflang without a link back (1), to an error (4), to an unmeasured page (5)."""
    e = p.select("_url", F.explode("alternates").alias("a")).select("_url", join_url(F.col("_url"), F.col("a.href")).alias("_dst")).where("_dst IS NOT NULL AND _dst <> _url").distinct()
    back = e.select(F.col("_dst").alias("_url"), F.col("_url").alias("_dst"), F.lit(True).alias("_back"))
    t = p.select(F.col("_url").alias("_dst"), F.col("status").alias("_ts")).dropDuplicates(["_dst"])
    j = e.join(t, "_dst", "left").join(back, ["_url", "_dst"], "left")
    return (
        _finding(j.where("_ts < 400 AND _back IS NULL"), "I18N-001", "warn", F.col("_dst")).unionByName(_finding(j.where("_ts >= 400"), "I18N-004", "error", F.col("_dst"))).unionByName(_finding(j.where("_ts IS NULL"), "I18N-005", "info", F.col("_dst")))
    )


def locale_groups(p: DataFrame) -> DataFrame:
    """Locale twins of which some declare no alternates: one finding per group."""
    loc = locale_of(F.col("_path"))
    rest = F.array_join(F.when(loc.isNull(), segments(F.col("_path"))).otherwise(F.slice(segments(F.col("_path")), 2, F.greatest(F.size(segments(F.col("_path"))), F.lit(1)))), "/")
    g = p.where("_html").groupBy("_host", rest.alias("_rest")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce(loc, F.lit(""))).alias("k"), F.bool_or(F.coalesce(F.size("alternates") <= 0, F.lit(True))).alias("bare"), F.min("_url").alias("_url"))
    return _finding(g.where("n >= 2 AND k >= 2 AND bare"), "I18N-002", "warn", F.concat(F.lit("/"), F.col("_rest")))


def repeated_metadata(p: DataFrame) -> DataFrame:
    """Equal titles (2) and equal trimmed descriptions (6) on several pages: one finding per group."""
    out = None
    for code, c in (("META-002", F.col("title")), ("META-006", F.trim("description"))):
        g = p.where("_html").where(F.trim(c) != "").groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("n"), F.min("_url").alias("_url")).where("n > 1")
        f = _finding(g, code, "warn", F.col("_v"))
        out = f if out is None else out.unionByName(f)
    return out


def repeated_content(p: DataFrame) -> DataFrame:
    """Equal visible text on several pages: one finding per group."""
    g = p.where("_ok").where(F.trim("text") != "").groupBy(F.md5(F.encode(collapse(F.col("text")), "utf-8")).alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.min("_url").alias("_url")).where("n > 1")
    return _finding(g, "DUP-001", "warn", F.col("_h"))


def edges_of(p: DataFrame) -> DataFrame:
    """Same-host links ``src, dst, location`` of all pages."""
    e = p.select(F.col("_url").alias("src"), "_host", F.explode("links").alias("l")).select("src", "_host", join_url(F.col("src"), F.col("l.href")).alias("dst"), F.col("l.location").alias("location"))
    return e.where("dst IS NOT NULL").where(url_parts(F.col("dst"))["host"] == F.col("_host")).select("src", "dst", "location")


def link_targets(p: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Links to errors (1) and navigation or footer links that lead nowhere useful (5). ``edges`` are
    src, dst and location, where they don't come from the pages' own links."""
    t = p.select(F.col("_url").alias("dst"), F.col("status").alias("_ts"), "indexability").dropDuplicates(["dst"])
    j = (edges_of(p) if edges is None else edges).join(t, "dst").withColumn("_url", F.col("src"))
    dead = _finding(j.where("_ts >= 400"), "LINK-001", "error", F.col("dst")).distinct()
    leak = _finding(j.where("location IN ('nav', 'footer') AND (_ts >= 400 OR indexability <> 'indexable')"), "LINK-005", "warn", F.col("dst")).distinct()
    return dead.unionByName(leak)


def link_depths(p: DataFrame, seeds: DataFrame, edges: DataFrame | None = None, deep: int = 3) -> DataFrame:
    """Orphans (2) and pages more than three hops from the nearest seed (3). ``seeds`` has a column ``node``."""
    start = seeds.select(canonical_url(F.col("node")).alias("node"))
    j = p.where("_ok").join(depths(edges_of(p) if edges is None else edges, start).withColumnRenamed("node", "_url"), "_url", "left")
    return _finding(j.where("depth IS NULL AND _path <> '/'"), "LINK-002", "warn").unionByName(_finding(j.where(F.col("depth") > deep), "LINK-003", "info"))


def quiet_authorities(p: DataFrame, ranks: DataFrame, impressions: DataFrame) -> DataFrame:
    """LINK-004: indexable pages of more than median authority that nobody is shown.

    ``ranks`` is node, rank; ``impressions`` url, gsc_impressions. The median is the upper one; it is
    found among the ranks in order, not by collecting them.
    """
    ok = p.where("_ok").join(ranks.select(F.col("node").alias("_url"), "rank"), "_url").join(impressions.select(F.col("url").alias("_url"), "gsc_impressions"), "_url", "left")
    placed = ranked(ok, [F.asc("rank"), F.asc("_url")], "_k")
    middle = placed.where(F.col("_k") == ok.count() // 2 + 1).select("rank").first()  # one number
    hit = placed.where(F.col("rank") > (middle["rank"] if middle else 0.0)).where(F.coalesce("gsc_impressions", F.lit(0)) == 0)
    return _finding(hit, "LINK-004", "info")


def city_queries(p: DataFrame) -> DataFrame:
    """Pages for ?city= beside a path page of that city (CANN-002), city paths that redirect to ?city= (CANN-003).

    The city is looked for in every path of the host by its words: a path page is entered under each of
    its segments and their parts, so that pages meet by equal text instead of all with all. Subject is the other URL.
    """
    parts = url_parts(F.col("_url"))
    q = p.withColumn("_q", parts["query"])
    city = query_value(F.col("_q"), "city")
    asking = q.where("status = 200 AND indexability <> 'noindex' AND coalesce(media, 'html') = 'html'").select("_url", "_host", city.alias("_city")).where("_city <> ''")
    names = F.array_distinct(F.flatten(F.transform(segments(F.col("_path")), _runs)))
    paths = q.where("status = 200 AND indexability = 'indexable' AND _q IS NULL").select(F.col("_url").alias("_other"), "_host", F.explode(names).alias("_city"))
    beside = asking.join(paths, ["_host", "_city"]).groupBy("_url").agg(F.min("_other").alias("_other"))
    last = F.try_element_at("redirects", F.lit(-1))["to"]
    moved = p.where("indexability = 'redirected'").withColumn("_to", join_url(F.col("_url"), last)).withColumn("_city", query_value(url_parts(F.col("_to"))["query"], "city"))
    handed = moved.where(F.col("_city").isNotNull() & (city_shaped(F.col("_path")) | F.col("_path").contains(F.col("_city"))))
    return _finding(beside, "CANN-002", "warn", F.col("_other")).unionByName(_finding(handed, "CANN-003", "warn", F.col("_to")))


def _runs(segment: Column) -> Column:
    """Runs of the hyphenated words of a path segment."""
    w = F.split(segment, "-")
    n = F.size(w)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(w, i, j - i + 1), "-"))))


def default_alternates(p: DataFrame) -> DataFrame:
    """I18N-003, where the policy asks for it: pages with alternates of which none is x-default."""
    lacks = (F.size("alternates") > 0) & ~F.exists("alternates", lambda a: F.lower(a["hreflang"]) == "x-default")
    return _finding(p.where("_html").where(lacks), "I18N-003", "warn")


def agent_access(matrix: DataFrame, probes: DataFrame, roles: str = "search_discovery") -> DataFrame:
    """AI-004: origins whose llms.txt answers 404. AI-005: listed crawlers that are kept out of a whole
    origin, a warning for those that discover pages for search. ``matrix`` is robots.agent_matrix(), ``probes`` origin and llms_status."""
    lacking = probes.where("llms_status = 404").select(F.lit("SE-AI-004").alias("code"), F.lit("AI").alias("family"), F.lit("info").alias("severity"), F.col("origin").alias("url"), F.col("origin").alias("subject"))
    kept = matrix.where("policy_intent = 'BLOCK'").select(F.lit("SE-AI-005").alias("code"), F.lit("AI").alias("family"), F.when(F.col("role") == roles, "warn").otherwise("info").alias("severity"), F.col("origin").alias("url"), F.col("agent").alias("subject"))
    return lacking.unionByName(kept)


def host_security(p: DataFrame) -> DataFrame:
    """Header rules per host over its HTML pages with status 200; the first page stands for it."""
    h = lambda n: F.col("headers")[n]
    csp = h("content-security-policy").isNotNull() | F.col("csp_meta").isNotNull()
    hsts, zero = h("strict-transport-security"), ~F.coalesce(h("strict-transport-security"), F.lit("")).rlike("(?i)max-age\\s*=\\s*\"?0*[1-9]")
    g = p.where("status = 200").where(F.coalesce("media", F.lit("html")) == "html").groupBy("_host").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_url", "ordinal").alias("_url"), F.count_if(hsts.isNotNull()).alias("hsts"), F.bool_and(F.when(hsts.isNotNull(), zero).otherwise(True)).alias("zero"),
        F.bool_and(F.lower(F.coalesce(h("x-content-type-options"), F.lit(""))) == "nosniff").alias("nosniff"), F.count_if(csp).alias("csp"),
        F.bool_or(F.lower(F.coalesce(h("content-security-policy"), F.lit(""))).contains("frame-ancestors")).alias("ancestors"), F.count_if(h("x-frame-options").isNotNull()).alias("xfo"), F.count_if(h("referrer-policy").isNotNull()).alias("rp"),
    )
    https = F.col("_url").startswith("https://")
    rules = [
        ("SEC-001", "warn", https & (F.col("hsts") == 0)), ("SEC-007", "warn", https & (F.col("hsts") > 0) & (F.col("hsts") < F.col("n"))), ("SEC-006", "warn", https & (F.col("hsts") == F.col("n")) & F.col("zero")),
        ("SEC-002", "info", ~F.col("nosniff")), ("SEC-007", "warn", (F.col("csp") > 0) & (F.col("csp") < F.col("n"))), ("SEC-003", "info", F.col("csp") == 0),
        ("SEC-004", "info", ~F.col("ancestors") & (F.col("xfo") == 0)), ("SEC-005", "info", F.col("rp") == 0),
    ]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(f"SE-{k}").alias("code"), F.lit(s).alias("severity"))) for k, s, c in rules]), lambda x: x.isNotNull())
    return g.select(F.explode(hits).alias("h"), "_url", "_host").select("h.code", F.lit("SEC").alias("family"), "h.severity", F.col("_url").alias("url"), F.col("_host").alias("subject"))


def shared_controls(p: DataFrame) -> DataFrame:
    """Unlabelled controls: one finding for a host where three pages and half of all have them, else per page."""
    ok = p.where("_ok")
    bad = F.col("unlabeled_controls") > 0
    hosts = ok.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_b"), F.min(F.when(bad, F.struct("ordinal", "_url"))).alias("_first"))
    hosts = hosts.withColumn("_shared", (F.col("_b") >= 3) & (F.col("_b") * 2 >= F.col("_n")))
    single = ok.where(bad).join(hosts.where("NOT _shared").select("_host"), "_host", "left_semi")
    return _finding(single, "A11Y-005", "warn").unionByName(_finding(hosts.where("_shared").withColumn("_url", F.col("_first._url")), "A11Y-005", "warn", F.col("_host")))


def publishers(p: DataFrame) -> DataFrame:
    """Hosts whose publisher JSON-LD never has an id or a sameAs."""
    b = p.where("_ok").select("_host", "_url", "ordinal", F.explode("json_ld").alias("b")).where(F.exists("b.types", lambda t: F.lower(F.regexp_replace(t, "^.*/", "")).isin(PUBLISHER_TYPES)))
    g = b.groupBy("_host").agg(F.bool_or(F.coalesce(F.size("b.ids") > 0, F.lit(False)) | F.coalesce(F.size("b.same_as") > 0, F.lit(False))).alias("cited"), F.min_by("_url", "ordinal").alias("_url"))
    return _finding(g.where("NOT cited"), "AI-001", "warn", F.col("_host"))


def all_findings(pages: DataFrame, seed: str) -> DataFrame:
    """Every page rule, in order of severity, code and subject."""
    p = with_state(pages)
    seeds = p.sparkSession.createDataFrame([(seed,)], "node string")
    parts = [page_local(p), canonical_targets(p), alternates(p), locale_groups(p), repeated_metadata(p), repeated_content(p), link_targets(p), link_depths(p, seeds), host_security(p), shared_controls(p), publishers(p), city_queries(p), schema_gaps(p)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return out.orderBy(rank, "code", "subject")
