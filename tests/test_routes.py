import pytest
from pyspark.sql import functions as F

from sievemark.operators import routes as RO
from sievemark.operators.binding import claim_graph, explain
from sievemark.operators.discovery import directed_seeds, frontier, next_batch, strongest
from sievemark.sources.policy import Policy, PolicyError, allows, parse_pack, parse_policy

FILES = [
    ("apps/web/src/app/[locale]/(shop)/services/[slug]/page.tsx", "import { seoTitle } from '@/lib/seo'\nimport type { X } from './types'\nimport a from './part'\nexport async function generateMetadata() {}\nexport function generateStaticParams() {}\nconst productJsonLd = {}\nexport default function Page() {}"),
    ("apps/web/src/app/@modal/(.)photo/[id]/page.tsx", ""), ("src/app/page.tsx", ""), ("src/app/_private/x/page.tsx", ""), ("src/app/docs/[...path]/page.mdx", ""), ("src/app/opt/[[...rest]]/page.js", ""),
    ("pages/blog/[slug].vue", ""), ("src/pages/index.astro", ""), ("pages/api/x.ts", ""), ("pages/_app.tsx", ""), ("src/lib/seo.ts", "import b from './deep/index'"), ("src/lib/deep/index.ts", "import c from '../../other'"), ("src/other.ts", ""), ("apps/web/src/app/[locale]/(shop)/services/[slug]/part.tsx", ""),
    ("next.config.mjs", "export default { basePath: '/base', trailingSlash: true, async redirects() { return [{ source: '/a', destination: '/b', permanent: true }, { source: '/c', destination: '/d' }] }, async rewrites() { return [{ source: '/r', destination: '/s' }] } }"), (None, None),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, source string")


def test_patterns_of_files(spark, files):
    got = {r.owner: r for r in RO.route_families(files).collect()}
    assert {o: r.pattern for o, r in got.items()} == {
        FILES[0][0]: "/:locale/services/:slug", "src/app/page.tsx": "/", "src/app/docs/[...path]/page.mdx": "/docs/*path", "src/app/opt/[[...rest]]/page.js": "/opt/*rest", "pages/blog/[slug].vue": "/blog/:slug", FILES[1][0]: "/:id",
    }
    r = got[FILES[0][0]]
    assert r.has_metadata and r.has_static_params and r.json_ld == ["productJsonLd"] and [tuple(h) for h in r.helpers] == [("seoTitle", "@/lib/seo")] and r.router == "app"
    assert files.select(RO.intercepting(F.col("path")).alias("i")).where("i IS NOT NULL").first().i == "photo"
    assert [r.pattern for r in RO.merge_surfaces(RO.route_families(files).limit(0), RO.route_families(files)).where("pattern = '/'").collect()] == ["/"]


def test_config_aliases_and_cone(spark, files):
    c = RO.config_of(files).first()
    assert (c.base_path, c.trailing_slash, [tuple(h) for h in c.redirects], [h.source for h in c.rewrites]) == ("/base", True, [("/a", "/b", True), ("/c", "/d", False)], ["/r"])
    assert RO.aliases_of('{ // x\n "compilerOptions": {"paths": {"@ui/*": ["./libs/ui/*"], "core": ["src/core.ts"]}}}') == [("@ui/*", "libs/ui/*"), ("core", "src/core.ts")]
    edges = {(r.src, r.dst) for r in RO.imports_of(files).collect()}
    assert edges == {(FILES[0][0], "src/lib/seo.ts"), (FILES[0][0], FILES[13][0]), ("src/lib/seo.ts", "src/lib/deep/index.ts"), ("src/lib/deep/index.ts", "src/other.ts")}
    own = RO.route_families(files).select(F.col("owner").alias("path"), "pattern")
    cone = RO.import_cone(own, RO.imports_of(files))
    assert {r.path for r in cone.where("pattern = '/:locale/services/:slug'").collect()} == {FILES[0][0], FILES[13][0], "src/lib/seo.ts", "src/lib/deep/index.ts", "src/other.ts"}
    hashes = RO.producer_hashes(files, cone)
    urls = spark.createDataFrame([("/en/services/x",), ("/blog/y",)], "path string")
    assert [tuple(r) for r in RO.impacted_urls(spark.createDataFrame([("src/other.ts",)], "path string"), hashes, urls).collect()] == [("src/other.ts", "/en/services/x")]


def test_routes_meet_paths(spark):
    patterns = spark.createDataFrame([(p,) for p in ("/:locale/services/:slug", "/docs/*path", "/", "/:a/:b", "/about", "/:locale", "/*all")], "pattern string")
    paths = ["/services/x", "/en/services/x/", "/docs", "/docs/a/b", "/", "/about/", "/de", "/x/y/z", "/en/about"]
    got = {(r.path, r.pattern) for r in RO.match_routes(spark.createDataFrame([(p,) for p in paths], "path string"), patterns).collect()}

    def fits(pattern, path):
        q, p = ([x for x in t.split("/") if x] for t in (pattern, path))
        if q and q[-1].startswith("*"):
            q, p = q[:-1], p[: len(q) - 1]
        return len(q) == len(p) and all(a.startswith(":") or a == b for a, b in zip(q, p))

    want = {(p, r.pattern) for p in paths for r in patterns.collect() if fits(r.pattern, p) or (r.pattern.startswith("/:locale") and fits(r.pattern[8:] or "/", p))}
    assert got == want


def test_policy(spark):
    text = "schema: x\nindexability:\n  include:\n    - /:locale/services/**\n    - '/blog/*' # posts\n  exclude: [/services/private]\ninternational:\n  x_default: /en\n"
    assert parse_policy(text) == Policy(("/:locale/services/**", "/blog/*"), ("/services/private",), "/en") == parse_policy('{"indexability": {"include": ["/:locale/services/**", "/blog/*"], "exclude": ["/services/private"]}, "international": {"x_default": "/en"}}')
    assert parse_policy("\ufefffeed: x\nindexability:\n  include: [/u]\n") == Policy(("/u",)) == parse_policy("indexability:\n  include: [/u]\n")
    for bad in ("{", "- a\n", "x\n"):
        with pytest.raises(PolicyError):
            parse_policy(bad)
    df = spark.createDataFrame([(p,) for p in ("/services/a", "/services/private", "/blog/a/b", "/admin/x", "/x")], "p string")
    assert [r.a for r in df.select(allows(F.col("p"), parse_policy(text)).alias("a")).collect()] == [True, False, False, False, False]
    assert [r.a for r in df.select(allows(F.col("p"), None).alias("a")).collect()] == [True, True, True, False, True]
    pack = parse_pack("id: p\nmarket: m\nmarkers: [a, b]\nentities:\n  - token: Foo\n    label: The Foo\n  - token: Bar\nclaims:\n  - id: c\n    phrases:\n      - one two\n    requires: f\nfacts:\n  - field: f\n    false: [f=false]\n")
    assert pack.entities == (("Foo", "The Foo"), ("Bar", "Bar")) and pack.claims[0].phrases == ("one two",) and pack.facts == (("f", ("f=false",)),)
    assert RO.policy_finding(spark, "bad").count() == 1 and RO.policy_finding(spark, None).count() == 0


def test_seeds_and_lanes(spark):
    o = spark.createDataFrame([("search_performance", "https://a.x/one"), ("bot_crawl", "https://a.x/one"), ("ai_prompt", "https://a.x/two"), ("backlink", "https://a.x/no"), ("bot_crawl", None), ("bot_crawl", "ftp://a.x/")], "kind string, url string")
    p = spark.createDataFrame([(f"https://a.x/services/s/town-{i}",) for i in range(4)] + [("https://a.x/services",), ("https://a.x/two",)], "url string")
    seeds = {r.url: r.source for r in directed_seeds(o, p).collect()}
    assert seeds["https://a.x/one"] == "gsc" and seeds["https://a.x/two"] == "ai_citation" and len(seeds) == 7
    q = frontier(directed_seeds(o, p, "a.x"), spark.createDataFrame([("services",)], "landing string"))
    lanes = {r.url: r.lane for r in q.collect()}
    assert [u for u, lane in lanes.items() if lane == "linked"] == ["https://a.x/services/s/town-2", "https://a.x/services/s/town-3"] or sorted(u for u, lane in lanes.items() if lane == "linked") == ["https://a.x/services/s/town-2", "https://a.x/services/s/town-3"]
    assert {r.url for r in next_batch(q, 2).collect()} == {"https://a.x/one", "https://a.x/two"}
    assert strongest(spark.createDataFrame([("https://a.x/", "sitemap"), ("https://a.x", "explicit")], "url string, source string")).first().source == "explicit"


def test_chains(spark):
    claims = spark.createDataFrame([("https://a.x/", "c", "p", "f")], "url string, claim string, pack string, requires string")
    nodes, facts = claim_graph(claims)
    more = spark.createDataFrame([("url:https://a.x/", "route:/", "rendered_by"), ("route:/", "symbol:s", "generated_by"), ("route:/", "x", "mentions"), ("field:p#f", "span:1", "defined_at"), ("symbol:s", "y", "generated_by")], "source string, target string, relation string")
    got = {(r.subject, r.hop, r.relation, r.node) for r in explain(spark.createDataFrame([("https://a.x/",), ("https://b.x/",)], "subject string"), facts.unionByName(more), nodes).collect()}
    a = "https://a.x/"
    assert got == {(a, 0, "", f"url:{a}"), (a, 1, "rendered_by", "route:/"), (a, 2, "generated_by", "symbol:s"), (a, 1, "claims", "claim:p#c"), (a, 2, "governed_by", "policy:p"), (a, 2, "requires", "field:p#f"), (a, 3, "defined_at", "span:1"), ("https://b.x/", 0, "", "url:https://b.x/")}
