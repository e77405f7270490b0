from sievemark.operators.rules import all_findings, edges_of, page_local, with_state
from sievemark.sources.html import extract, extract_page
from sievemark.sources.robots import agent_matrix, allowed, robots_rules, sitemap_urls

FIELDS = (
    "url string, status int, media string, canonical string, robots array<string>, title string, description string, html_lang string, alternates array<struct<hreflang:string,href:string>>,"
    "headings array<struct<level:int,text:string>>, redirects array<struct<from:string,to:string,status:int>>, links array<struct<href:string,anchor:string,context:string,rel:array<string>,location:string>>,"
    "images array<struct<src:string,alt:string,hidden:boolean>>, json_ld array<struct<valid_json:boolean,types:array<string>,ids:array<string>,same_as:array<string>,raw:string,nodes:array<struct<types:array<string>,properties:array<string>>>>>, text string, og_title string, og_image string,"
    "headers map<string,string>, csp_meta string, body_bytes int, fetch_ms int, has_main boolean, unlabeled_controls int, in_sitemap boolean, ordinal bigint"
)
NAMES = [f.split()[0].split(":")[0] for f in FIELDS.replace("<", " <").split(", ") if " " in f]
GOOD_HEADERS = {"strict-transport-security": "max-age=99", "x-content-type-options": "nosniff", "content-security-policy": "frame-ancestors 'self'", "referrer-policy": "origin"}


def page(url, n=0, **more):
    base = dict(url=url, status=200, media="html", canonical=url, robots=[], title=f"title {url}", description=f"about {url}", html_lang="en", alternates=[], headings=[(1, "h")], redirects=[], links=[], images=[], json_ld=[], text=f"text of {url}", og_title="t", og_image="https://e.com/i.png", headers=dict(GOOD_HEADERS), csp_meta=None, body_bytes=10, fetch_ms=10, has_main=True, unlabeled_controls=0, in_sitemap=False, ordinal=n)
    return {**base, **more}


def link(href, location="contextual"):
    return (href, "a", None, [], location)


def codes(spark, pages):
    df = spark.createDataFrame([tuple(p.values()) for p in pages], ", ".join(FIELDS.split(", ")))
    return {(r.code, r.url) for r in all_findings(df, "https://e.com/").collect()}


def test_a_clean_site_stays_quiet(spark):
    home, a = page("https://e.com/", 0, links=[link("/a")]), page("https://e.com/a", 1, links=[link("/")])
    assert codes(spark, [home, a]) == set()


def test_rules_fire(spark):
    u = "https://e.com"
    pages = [
        page(f"{u}/", 0, links=[link("/dead"), link("/dead", "nav"), link("/a"), link("/b"), link("/c1"), link("/x"), link("/de/twin"), link("/en/twin"), link("/far1")]),
        page(f"{u}/dead", 1, status=404, in_sitemap=True), page(f"{u}/boom", 2, status=503), page(f"{u}/orphan", 3), page(f"{u}/hidden", 4, robots=["NOINDEX, follow"], in_sitemap=True),
        page(f"{u}/a", 5, canonical=f"{u}/dead", title="same", description=" d "), page(f"{u}/b", 6, canonical=f"{u}/nowhere"), page(f"{u}/c1", 7, canonical=f"{u}/c2"), page(f"{u}/c2", 8, canonical=f"{u}/c3"), page(f"{u}/c3", 9),
        page(f"{u}/x", 10, canonical=None, title=" ", description=None, html_lang=None, headings=[(2, "Frequently asked questions")], images=[("http://e.com/i.png", None, False)], has_main=False, og_title=None, og_image=None, body_bytes=600_000, fetch_ms=9_000, json_ld=[(False, [], [], [], '{', [])], unlabeled_controls=2, redirects=[("a", "b", 301), ("b", "c", 301)], text="Frequently asked questions"),
        page(f"{u}/de/twin", 11, title="dup", description="same d", text="equal text", alternates=[("en", f"{u}/en/twin"), ("fr", f"{u}/dead"), ("it", f"{u}/never")], json_ld=[(True, ["Organization"], [], [], '{}', [])]), page(f"{u}/en/twin", 12, title="dup", description=" same d", text="equal  text"),
        page(f"{u}/far1", 13, links=[link("far2")]), page(f"{u}/far2", 14, links=[link("far3")]), page(f"{u}/far3", 15, links=[link("far4")]), page(f"{u}/far4", 16, headings=[(1, "a"), (1, "b")]),
        page("https://bad.com/", 17, headers={}), page("https://half.com/", 18, headers={"strict-transport-security": "max-age=0"}), page("https://split.com/", 19), page("https://split.com/2", 20, headers={}),
    ]
    got = codes(spark, pages)
    want = {
        ("SE-CRAWL-001", f"{u}/dead"), ("SE-CRAWL-002", f"{u}/boom"), ("SE-CRAWL-003", f"{u}/x"), ("SE-CANON-001", f"{u}/x"), ("SE-CANON-002", f"{u}/a"), ("SE-CANON-003", f"{u}/c1"), ("SE-CANON-004", f"{u}/b"), ("SE-SITEMAP-001", f"{u}/dead"), ("SE-SITEMAP-002", f"{u}/hidden"),
        ("SE-I18N-001", f"{u}/de/twin"), ("SE-I18N-004", f"{u}/de/twin"), ("SE-I18N-005", f"{u}/de/twin"), ("SE-META-001", f"{u}/x"), ("SE-META-003", f"{u}/x"), ("SE-META-004", f"{u}/x"), ("SE-META-005", f"{u}/x"), ("SE-META-002", f"{u}/de/twin"), ("SE-META-006", f"{u}/de/twin"),
        ("SE-SCHEMA-001", f"{u}/x"), ("SE-LINK-001", f"{u}/"), ("SE-LINK-002", f"{u}/orphan"), ("SE-LINK-003", f"{u}/far4"), ("SE-LINK-005", f"{u}/"), ("SE-DUP-001", f"{u}/de/twin"), ("SE-CONTENT-001", f"{u}/x"), ("SE-CONTENT-002", f"{u}/far4"),
        ("SE-A11Y-001", f"{u}/x"), ("SE-A11Y-002", f"{u}/x"), ("SE-A11Y-004", f"{u}/x"), ("SE-A11Y-005", f"{u}/x"), ("SE-PERF-001", f"{u}/x"), ("SE-PERF-002", f"{u}/x"), ("SE-SEC-008", f"{u}/x"), ("SE-AI-001", f"{u}/de/twin"), ("SE-AI-002", f"{u}/x"),
        ("SE-SEC-001", "https://bad.com/"), ("SE-SEC-002", "https://bad.com/"), ("SE-SEC-003", "https://bad.com/"), ("SE-SEC-004", "https://bad.com/"), ("SE-SEC-005", "https://bad.com/"), ("SE-SEC-006", "https://half.com/"), ("SE-SEC-007", "https://split.com/"),
    }
    assert want - got == set()
    assert {c for c in got - want if c[1].startswith(u)} == {("SE-I18N-002", f"{u}/de/twin"), ("SE-LINK-002", f"{u}/c3")}


def test_null_signals_are_unmeasured(spark):
    p = {k: None for k in page("https://e.com/z")} | {"url": "https://e.com/z", "status": 200, "ordinal": 1}
    got = {c for c, _ in codes(spark, [page("https://e.com/", links=[link("/z")]), p])}
    assert {"SE-PERF-001", "SE-A11Y-004", "SE-SEC-008", "SE-SCHEMA-001", "SE-SITEMAP-002", "SE-A11Y-005"} & got == set() and "SE-META-001" in got
    assert codes(spark, []) == set()


def test_extraction(spark):
    html = '<html lang="de"><head><title> Ein  Titel</title><meta name="ROBOTS" content="noindex"><meta property="og:title" content="og"><link rel="canonical" href="/x"><link rel="alternate" hreflang="en" href="/en"></head><body><nav><a href="/n?a=1&amp;b=2">Nav</a></nav><main><h1>Kopf</h1><p><b>Wort – <br>mehr<script>var a = "</p>";</script><img src="i" alt=""><img src="j"><a href="b" rel="nofollow breadcrumb">hin</a><input id="q"><label>L <input></label></main><script type="application/ld+json">{"@type":"WebSite","sameAs":["s"],"x":{"@type":["FAQPage"]}}</script><script type="application/ld+json">{bad</script>'
    r = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(extract("h").alias("p")).collect()[0].p
    assert (r.title, r.html_lang, r.canonical, r.robots, r.og_title, r.has_main, r.text, r.unlabeled_controls) == ("Ein Titel", "de", "/x", ["noindex"], "og", True, "Wort mehr hin L", 1)
    assert [(x.href, x.location, x.context) for x in r.links] == [("/n?a=1&b=2", "nav", None), ("b", "breadcrumb", "Kopf")] and [i.alt for i in r.images] == ["", None]
    assert [(b.valid_json, b.types, b.same_as) for b in r.json_ld] == [(True, ["WebSite", "FAQPage"], ["s"]), (False, [], [])] and extract_page(None) is None
    assert edges_of is not None and page_local is not None and with_state is not None


def test_robots(spark):
    body = "# c\nUser-agent: *\nDisallow: /private\nAllow: /private/open$\n\nUser-agent: MirloBot\nUser-agent: other\nDisallow: /\nAllow: /*.html\nDisallow:\nSitemap: https://e.com/s.xml\n"
    files = spark.createDataFrame([("e", body), ("n", None)], "origin string, body string")
    asks = [("e", "someone", "/private/x", False), ("e", "someone", "/private/open", True), ("e", "someone", "/private/open2", False), ("e", "mirlobot-news", "/a", False), ("e", "mirlobot", "/a/b.html", True), ("e", "x", "/", True), ("n", "x", "/private", True)]
    got = allowed(spark.createDataFrame([a[:3] for a in asks], "origin string, agent string, path string"), robots_rules(files)).collect()
    assert {(r.origin, r.agent, r.path, r.allowed) for r in got} == set(asks)
    m = agent_matrix(files, spark.createDataFrame([("mirlobot", "M", "training"), ("free", "F", "archive")], "token string, provider string, role string")).collect()
    assert {(r.origin, r.agent): r.policy_intent for r in m} == {("e", "mirlobot"): "BLOCK", ("e", "free"): "UNDECLARED", ("n", "mirlobot"): "UNDECLARED", ("n", "free"): "UNDECLARED"}
    maps = spark.createDataFrame([("<urlset><url><loc> https://e.com/?a=1&amp;b=2 </loc></url><url><loc>https://e.com/?a=1&amp;b=2</loc></url></urlset>",), ("<sitemapindex><sitemap><loc><![CDATA[https://e.com/s2.xml]]></loc></sitemap></sitemapindex>",), (None,)], "body string")
    assert {tuple(r) for r in sitemap_urls(maps).collect()} == {("url", "https://e.com/?a=1&b=2"), ("sitemap", "https://e.com/s2.xml")}
