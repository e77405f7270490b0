from pyspark.sql import functions as F

from sievemark.operators import claims as CL
from sievemark.operators import competitors as K
from sievemark.operators import matrices as M
from sievemark.operators import planning as P
from sievemark.operators import render as RE
from sievemark.operators import rules as R
from sievemark.operators import vectors as V
from sievemark.operators.content import family_shares, lexical_measures, page_chunks, template_families
from tests.test_rules import FIELDS, link, page

U = "https://e.com"


def state(spark, pages):
    return R.with_state(spark.createDataFrame([tuple(p.values()) for p in pages], FIELDS))


def block(kind, raw="{}", props=()):
    return (True, [kind], [], [], raw, [([kind], list(props))])


def empty(spark):
    return state(spark, []).withColumn("_linked", F.lit(True))


def test_schema_requirements(spark):
    pages = [page(f"{U}/a", json_ld=[block("https://schema.org/Product", props=["NAME"]), block("schema:Offer", props=["priceSpecification"]), block("HowTo", props=["name", "step"]), (False, ["Product"], [], [], "{", [])]), page(f"{U}/b", json_ld=[block("FAQPage"), block("Organization"), block("Unknown")]), page(f"{U}/c", json_ld=None)]
    got = {(r.code, r.url, r.subject) for r in R.schema_gaps(state(spark, pages)).collect()}
    assert got == {("SE-SCHEMA-002", f"{U}/a", "Product/Product: review OR aggregateRating OR offers"), ("SE-SCHEMA-004", f"{U}/b", "FAQPage/FAQ: mainEntity"), ("SE-SCHEMA-003", f"{U}/b", "Organization/Organization: name")}
    assert R.schema_gaps(empty(spark)).count() == 0


def test_town_searches(spark):
    pages = [page(f"{U}/find?city=port-lisette", canonical=None), page(f"{U}/en/services/x-port-lisette"), page(f"{U}/find?city=no", canonical=None), page(f"{U}/find?city=", canonical=None), page(f"{U}/city/old", status=301, redirects=[("a", "/find?city=old", 301)]), page(f"{U}/plain", status=301, redirects=[("a", "/find?city=else", 301)])]
    got = {(r.code, r.url, r.subject) for r in R.city_queries(state(spark, pages)).collect()}
    assert got == {("SE-CANN-002", f"{U}/find?city=port-lisette", f"{U}/en/services/x-port-lisette"), ("SE-CANN-003", f"{U}/city/old", f"{U}/find?city=old")}


PACKS = [CL.Pack("a", "A", ("alpha",), (("Alpha Town", "Alpha"), ("A&B", "AB")), (CL.Claim("c", ("fully  Insured",), "ok"),), (("ok", ("ok:false",)),)), CL.Pack("b", "B", ("beta",), (("Beta", "Beta"),))]
SIGNALS = CL.Signals(hosts=(("B", ".b.com"),), languages=(("A", "xx"),), texts=(("A", "alpha"),))


def test_markets_claims_and_entities(spark):
    pages = [
        page(f"{U}/1", text="alpha town and BETA, A&B; fully insured"), page(f"{U}/2", text="Betas only alphabet"), page("https://x.b.com/", text="alpha town"), page(f"{U}/3", text="nothing"), page(f"{U}/4", text=None, html_lang="XX"), page(f"{U}/5", status=404, text="alpha Beta"),
    ]
    p = state(spark, pages)
    assert {r.url: r._market for r in CL.with_market(p, SIGNALS).select("url", "_market").collect()} == {f"{U}/1": "A", f"{U}/2": "A", "https://x.b.com/": "B", f"{U}/3": None, f"{U}/4": "A", f"{U}/5": "A"}
    assert {(r.url, r.subject) for r in CL.market_findings(p, PACKS, SIGNALS).collect()} == {(f"{U}/1", "Beta"), ("https://x.b.com/", "Alpha")}
    hebrew = state(spark, [page(f"{U}/h", text="alpha חשמל")])
    assert [r.subject for r in CL.market_findings(hebrew, PACKS, SIGNALS, ("A",)).collect()] == ["Hebrew script"]
    claims = CL.page_claims(p, PACKS, SIGNALS)
    files = spark.createDataFrame([("x/alpha.ts", "a\nok : FALSE\nbeta"), ("y.ts", "ok = 1"), (None, None), ("z.ts", None)], "path string, source string")
    facts = CL.false_facts(files, PACKS)
    assert [(r.pack, r.field, r.path, r.line) for r in facts.collect()] == [("a", "ok", "x/alpha.ts", 2)]
    assert [(r.code, r.url, r.subject) for r in CL.claim_findings(claims, facts).collect()] == [("SE-CLAIM-001", f"{U}/1", "c")] and CL.claim_findings(claims, facts.limit(0)).count() == 0
    assert {(r.url, r.subject) for r in CL.source_entities(files, PACKS).collect()} == {("x/alpha.ts", "a: Beta")}
    shared = [page(f"{U}/s{i}", i, text="alpha town" + (" A&B" if i == 0 else ""), json_ld=[block("Place", '"Alpha Town"')] if i == 3 else []) for i in range(4)]
    assert {(r.url, r.subject) for r in CL.entity_findings(state(spark, shared), PACKS, SIGNALS).collect()} == {(f"{U}/s0", "e.com:chrome:Alpha"), (f"{U}/s0", "AB")}
    assert CL.entity_findings(empty(spark), PACKS, SIGNALS).count() == 0 and CL.market_findings(empty(spark), PACKS, SIGNALS).count() == 0


def test_town_pages_need_a_place(spark):
    pages = [page(f"{U}/city/a"), page(f"{U}/city/b", json_ld=[block("Service", "{}")]), page(f"{U}/cities/c", json_ld=[block("Place", '{"Area Served": 1, "areaServed" : "x"}')]), page(f"{U}/other")]
    assert {(r.code, r.url) for r in CL.town_findings(state(spark, pages)).collect()} == {("SE-ENTITY-002", f"{U}/city/a"), ("SE-LOCAL-001", f"{U}/city/b")}


def test_rendered_pages(spark):
    p = state(spark, [page(f"{U}/a", 0, title="T  x", headings=[(1, "H")], json_ld=[block("WebSite")]), page(f"{U}/b", 1, title=None, canonical=None), page(f"{U}/c", 2, status=404)])
    rows = [(f"{U}/a", " T x ", "https://other.com/a", "H", ["WebSite"]), ("https://copy.com/b", "New", "/else", None, ["FAQPage", "FAQPage"]), (f"{U}/c", "x", "y", "z", ["Q"]), (f"{U}/gone", None, None, None, None), ("/a", None, "", None, [])]
    r = spark.createDataFrame(rows, "url string, title string, canonical string, h1 string, json_ld_types array<string>")
    got = {(x.code, x.subject) for x in RE.reconcile(p, r).collect()}
    assert got == {("SE-RENDER-003", "https://copy.com/b:title"), ("SE-RENDER-004", "https://copy.com/b:canonical"), ("SE-RENDER-006", "https://copy.com/b:FAQPage"), ("SE-RENDER-007", f"{U}/gone")}
    assert {x.url: x.state for x in RE.layer_states(p, r).collect()} == {f"{U}/a": "expected", "https://copy.com/b": "contradicted", f"{U}/c": "expected", f"{U}/gone": "render_only", "/a": "expected"}
    assert RE.reconcile(empty(spark), r.limit(0)).count() == 0


def test_families_gates_and_thin_towns(spark):
    town = lambda s, t, text, **k: page(f"{U}/services/{s}/{t}", text=text, headings=[(1, "h")], in_sitemap=True, **k)
    pages = [town("roof", "camas-wa", "Roof in Camas WA. Same words 7"), town("roof", "salem-or", "Roof in Salem OR. Same words 7"), town("tile", "salem-or", "Tiles alone 12 in salem"), town("tile", "camas-wa", "Tiles quite different 31 words in camas"), town("none", "salem-or", None, robots=["noindex"]), page(f"{U}/about")]
    p = state(spark, pages).withColumn("_linked", F.col("url").contains("tile"))
    links = spark.createDataFrame([(f"{U}/category/tile/bend-or",), (f"{U}/category/tile/about",)], "dst string")
    m = M.compile_matrices(p, links, spark.createDataFrame([("/:locale/x/:city",), ("/plain",), (None,)], "pattern string"))
    got = {r.family: r for r in m.collect()}
    assert {f: r.verdict for f, r in got.items()} == {"category/roof": "REVIEW", "category/tile": "SAFE_IF_REQUIREMENTS_MET", "category/none": "NOINDEX_BY_DEFAULT", "/:locale/x/:city": "UNMEASURED"}
    assert got["category/tile"].estimated_cardinality == 3 and got["category/tile"].measured_sample_rate == 66 and got["category/roof"].gates["discovery_support"] == "failed"
    assert {(r.url, r.subject) for r in M.thin_towns(p).collect()} == {(f"{U}/services/roof/camas-wa", "category/roof:2")}
    f = M.town_family(F.col("_path"))
    shares = family_shares(p.where("_ok").withColumn("_f", f), F.col("_f.family"), F.col("_f.town"), "_url")
    s = {r.family: r for r in shares.collect()}
    # roof: roof in same words are shared by both pages, camas wa and salem or are the towns
    assert (s["category/roof"].template_shared_ratio, s["category/roof"].parameter_substitution_ratio, s["category/roof"].measured_urls) == (66, 33, 2)
    assert template_families(shares).count() == 0
    e = {r.family: r for r in M.enrich(m, shares).collect()}
    assert e["category/tile"].verdict == "SAFE_TO_GENERATE" and e["category/tile"].gates["doorway_risk"] in ("passed", "unmeasured") and e["/:locale/x/:city"].fact_coverage is None
    none = spark.createDataFrame([], "subject_family string")
    a = {r.family: r for r in M.annotate(M.enrich(m, shares), spark.createDataFrame([("category/tile", 1, 5)], "family string, gsc_clicks long, gsc_impressions long"), none).collect()}
    assert a["category/tile"].demand_coverage == 100 and a["category/tile"].claim_integrity is None
    assert M.compile_matrices(empty(spark), links.limit(0)).count() == 0 and M.thin_towns(empty(spark)).count() == 0


def test_gaps_between_sites(spark):
    mine, theirs = [page("https://a.com/service/one", title="x"), page("https://a.com/")], [page(f"https://b.com/service/{i}", title="x", html_lang="FR") for i in range(6)] + [page("https://b.com/faq", json_ld=[block("FAQPage")], alternates=[("he-IL", "https://b.com/he")])]
    p = state(spark, mine + theirs)
    edges = spark.createDataFrame([("b.com",)] * 9 + [("a.com",)], "site string")
    got = {(r.kind, r.subject) for r in K.gaps(K.shapes(p), K.totals(p, edges), "a.com").collect()}
    assert got == {("cluster_gap", "b.com:faq"), ("cluster_gap", "b.com:prefix:/faq"), ("market_gap", "b.com:locale:fr"), ("market_gap", "b.com:locale:he-il"), ("schema_gap", "FAQPage"), ("cluster_gap", "b.com:service:cardinality"), ("link_gap", "b.com")}
    alone = state(spark, mine)
    assert [(r.kind, r.subject) for r in K.gaps(K.shapes(alone), K.totals(alone, edges.limit(0)), "a.com").collect()] == [("cluster_gap", "compare")]
    assert K.capabilities(pages=p, none=None, empty=p.limit(0)) == [("pages", True), ("none", False), ("empty", False)]


def test_plans(spark):
    items = spark.createDataFrame([("link_gap", "u"), ("create_family", "u"), ("odd", "v"), ("cannibal", None)], "kind string, subject string")
    st = P.plan_stages(items)
    assert [(r.stage, r.requires, r.relation) for r in st.where("kind = 'create_family'").orderBy("stage_no").collect()] == [("ADD_FACT", None, None), ("BIND_ENTITY", "ADD_FACT", "REQUIRES"), ("ADD_SCHEMA", "BIND_ENTITY", "REQUIRES"), ("CRAWL", "ADD_SCHEMA", "VERIFY_AFTER"), ("OBSERVE_GSC", "CRAWL", "VERIFY_AFTER")]
    assert [(r.subject, r.waits_for) for r in P.plan_links(st).collect()] == [("u", "OBSERVE_GSC")]
    prod = spark.createDataFrame([("f", "p.ts", "1"), ("f", "@x", "2"), ("g", "q.ts", "3"), (None, "r.ts", "4")], "family string, path string, hash string")
    targets = P.handoff(spark.createDataFrame([("f", "CREATE", "f"), ("u", "LINK", "g"), ("n", "LINK", None)], "subject string, action string, family string"), prod)
    assert {(r.path, r.subject) for r in targets.collect()} == {("p.ts", "f"), ("q.ts", "u")}
    stale = P.stale_targets(targets, prod.where("path <> 'q.ts'").withColumn("hash", F.lit("9")), "r1", "r2")
    assert {(r.path, r.reason) for r in stale.collect()} == {("p.ts", "hash changed"), ("q.ts", "gone"), (None, "source changed (r1 to r2)")}
    many = spark.range(500).select(F.lit("link_gap").alias("kind"), F.col("id").cast("string").alias("subject"), F.when(F.col("id") % 2 == 0, F.lit(60)).alias("confidence"), F.lit(10).alias("risk"), (F.col("id") % 7).cast("int").alias("demand"), F.lit(None).cast("int").alias("visibility_gap"), F.lit(1).alias("cost"))
    got = [(r.rank, r.trust, r.demand, r.subject) for r in P.rank_opportunities(many).orderBy("rank").collect()]
    assert [g[0] for g in got] == list(range(1, 501)) and got == sorted(got, key=lambda g: (-g[1], -g[2], g[3])) or [g[1:] for g in got] == [g[1:] for g in sorted(got, key=lambda g: (-g[1], -g[2], g[3]))]


def test_texts_in_numbers(spark):
    import math

    texts = ["a1 b2 c3 a1", "one", "", None, "the same word " * 40, " ".join(f"w{i % 37} x{i % 5}" for i in range(200))]
    got = {r.doc_id: (r.term_entropy, r.mattr, r.mtld) for r in lexical_measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def brute(toks):
        n, seen, run, factors = len(toks), set(), 0, 0
        p = [toks.count(t) / n for t in set(toks)]
        e = 0 if len(p) == 1 else round(-sum(x * math.log2(x) for x in p) / math.log2(len(p)) * 100)
        m = len(set(toks)) * 100 // n if n < 50 else sum(len(set(toks[i : i + 50])) for i in range(n - 49)) * 100 // ((n - 49) * 50)
        for t in toks:
            run += 1
            seen.add(t)
            if run >= 10 and len(seen) * 100 // run < 72:
                factors, run, seen = factors + 1, 0, set()
        return e, m, None if n < 20 else 100 if not factors else min(n * 100 // (factors * 10), 100)

    assert got == {i: brute(t.split()) for i, t in enumerate(texts) if t}


def test_chunks_by_heading(spark):
    rows = [("a", "T", [(1, "Alpha part"), (2, "Beta")], "Intro Alpha one two three. beta four five six."), ("b", None, [(1, "Only")], "First one here. Second one here. Third one here. Fourth one here."), ("c", "Title", [], "short"), ("d", "x", [], " "), ("e", None, None, None)]
    got = {(r.url, r.chunk_no): (r.heading, r.body) for r in page_chunks(spark.createDataFrame(rows, "url string, title string, headings array<struct<level:int,text:string>>, text string"), keep=("heading", "body")).collect()}
    assert got == {("a", 0): ("Alpha part", "Alpha one two three."), ("a", 1): ("Beta", "beta four five six."), ("b", 0): ("Only First one here.", "Only First one here. Second one here. Third one here."), ("b", 1): ("Fourth one here.", "Fourth one here."), ("c", 0): ("Title", "short")}


def test_links_and_intents(spark):
    head = lambda t: [(1, t)]
    pages = [page(f"{U}/a/", 0, headings=head("repair old clocks"), text="one"), page(f"{U}/b", 1, headings=head("Repair clocks"), text="see repair old clocks today"), page(f"{U}/c", 2, headings=head("other things"), text="three", html_lang="de"), page(f"{U}/x/roof/salem-or", 3, headings=head("repair clocks"), text="ff"), page(f"{U}/x/tile/salem-or", 4, headings=head("repair clocks"), text="gg")]
    p = state(spark, pages).withColumn("_linked", F.col("ordinal") < 2)
    pairs = [(f"{U}/a/", f"{U}/b", 0.9), (f"{U}/b", f"{U}/a/", 0.9), (f"{U}/a/", f"{U}/c", 0.9), (f"{U}/x/roof/salem-or", f"{U}/x/tile/salem-or", 0.95), (f"{U}/a/", f"{U}/x/roof/salem-or", 0.5)]
    near = spark.createDataFrame(pairs, "a string, b string, cosine double")
    assert [(r.url, r.subject) for r in V.same_intent(p, near).collect()] == [(f"{U}/a/", f"{U}/b")]
    prof = V.link_profiles(p, spark.createDataFrame([(f"{U}/b", 0.2)], "node string, rank double"))
    assert {r.url: (r.cornerstone, r.orphan) for r in prof.collect()}[f"{U}/a/"] == (True, False)
    rec = V.recommend_links(prof, near, spark.createDataFrame([(f"{U}/a/", f"{U}/b")], "src string, dst string"))
    got = {(r.url, r.target): (r.severity, r.anchor, r.found) for r in V.anchor_texts(rec, p).collect()}
    assert got == {(f"{U}/b", f"{U}/a/"): ("info", "repair old clocks", True), (f"{U}/x/roof/salem-or", f"{U}/x/tile/salem-or"): ("warn", "repair clocks", False), (f"{U}/a/", f"{U}/x/roof/salem-or"): ("warn", "repair clocks", False)}
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, "zeta"), (4, None)], "doc_id long, text string")
    assert [r.doc_id for r in V.similar(docs, 1, 2).collect()] == [2] and V.similar(docs, 99).count() == 0 and V.retrieve(docs, "!").count() == 0
    ch = docs.select(F.lit("u").alias("url"), F.col("doc_id").alias("chunk_no"), F.col("text").alias("body"))
    assert [(r.chunk_no, r.relevance) for r in V.chunks_for(ch, "zeta", 1).collect()] == [(3, 100)] and [r.relevance for r in V.chunks_for(ch, "?", 2).collect()] == [None, None]
    assert link is not None
