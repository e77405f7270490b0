import random

import pytest

from sievemark.operators.graph import components, degrees, depths, page_rank, template_frequency
from sievemark.operators.similarity import near_duplicate_classes, similar_pairs
from sievemark.operators.vectors import holder, keyword_retrieve, lexical_embedding, nearest, query_tokens, retrieve, similar
from sievemark.plans import dsl, graphs

EDGES = "src string, dst string, location string, node string, rank double"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "nav", "own", 1.0) for a, b in pairs], EDGES)


def test_rank_depth_and_components_against_brute_force(spark):
    r = random.Random(2)
    pairs = [(r.choice("abcdefgh"), r.choice("abcdefghij")) for _ in range(25)] + [("x", "y"), (None, "a"), ("a", None), ("x", "y")]
    real = [(a, b) for a, b in pairs if a and b]
    nodes = sorted({n for e in real for n in e})
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * sum(rank[n] for n in nodes if all(a != n for a, _ in real)) / len(nodes))
        for a, b in real:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in real)
        rank = new
    got = {x.node: x["rank"] for x in page_rank(edges(spark, pairs)).collect()}
    assert set(got) == set(nodes) and all(abs(got[n] - rank[n]) < 1e-9 for n in nodes)
    seen, front = {"a": 0}, ["a"]
    while front:
        front = [b for n in front for a, b in real if a == n and b not in seen and not seen.update({b: seen[n] + 1})]
    assert {x.node: x.depth for x in depths(edges(spark, pairs), spark.createDataFrame([("a",), (None,)], "node string")).collect()} == seen
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in real:
            label[a] = label[b] = min(label[a], label[b])
    assert {x.node: x.component for x in components(edges(spark, pairs)).collect()} == {n: label[n] for e in real if e[0] != e[1] for n in e}
    assert {(x.node, x.outbound, x.inbound) for x in degrees(edges(spark, pairs)).where("node = 'x'").collect()} == {("x", 2, 0)}
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    assert {x.component for x in components(edges(spark, chain)).collect()} == {"000"}


def test_empty_graph(spark):
    e = edges(spark, [])
    assert page_rank(e).count() == components(e).count() == degrees(e).count() == template_frequency(e, 3).count() == 0


def test_near_duplicates_lose_no_link(spark):
    r = random.Random(7)
    base = [[r.choice("abcdefghijklmnop") * 2 + str(r.randrange(50)) for _ in range(60)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(8):
            t = list(b)
            for _ in range(r.randrange(3)):
                t[r.randrange(60)] = "new" + str(r.randrange(999))
            texts.append(" ".join(t))
    texts += ["short one", "short one", "Short, one!", None, "", "  ", "zz"] + [texts[0]] * 20
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, rep string")

    def shingles(t):
        w = [x for x in "".join(c.lower() if c.isalnum() else " " for c in t).split() if len(x.encode()) >= 2]
        return frozenset(w if len(w) < 5 else (" ".join(w[i : i + 5]) for i in range(len(w) - 4)))

    first = {}
    for i, t in enumerate(texts):
        if t and shingles(t):
            first.setdefault(shingles(t), i)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) / len(x | y) >= 0.8}
    links, member = similar_pairs(docs)
    assert {(x.a, x.b) for x in links.collect()} == want and len(want) > 20
    assert {x.doc_id: x.rep for x in member.collect()} == {i: first[shingles(t)] for i, t in enumerate(texts) if t and shingles(t)}
    classes = {x.doc_id: x.class_id for x in near_duplicate_classes(docs).collect()}
    assert all(classes[a] == classes[b] for a, b in want) and classes[48] == classes[50] == 48
    assert near_duplicate_classes(docs.limit(0)).count() == 0


def test_texts_without_tokens_are_classes_of_their_own(spark):
    texts = ["one two three four five six", None, "", "  ", "?! …", "a b c", "one two three four five six", "zz"]
    rows = near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == [(i, 0 if i == 6 else i, 0) for i in range(len(texts))]


def test_depth_of_a_long_chain(spark):
    chain = [(f"p{i}", f"p{i + 1}") for i in range(67)]
    got = {x.node: x.depth for x in depths(edges(spark, [*chain, ("far", "p0"), ("p67", "p3")]), spark.createDataFrame([("p0",)], "node string")).collect()}
    assert got == {f"p{i}": i for i in range(68)}


def test_template_links_need_half_of_a_sites_pages(spark, tmp_path):
    url = lambda site, n: f"url:https://{site}.example/{n}"
    link = lambda i, src, dst: (i, src, dst, "url", "url", "http")
    links = [(url(site, n), url(site, "hub")) for site in ("small", "large", "closed", "away") for n in range(4)] + [(url("small", 0), url("small", "x"))] * 2 + [(url("small", n), url("large", "hub")) for n in range(2)]
    pages = [("s1", f"https://{site}.example/{n}", "indexable") for site, most in (("small", 8), ("large", 9)) for n in range(most)]
    pages += [("s2", *p[1:]) for p in pages] + [("s1", f"https://small.example/no{n}", "noindex") for n in range(9)] + [("s1", "https://closed.example/", "noindex"), ("s1", None, "indexable"), ("s1", "no url", "indexable")]
    spark.createDataFrame([link(i, *x) for i, x in enumerate(links)], "edge_id long, source string, target string, source_kind string, target_kind string, evidence_source string").write.parquet(f"{tmp_path}/fact_edges.parquet")
    spark.createDataFrame(pages, "snapshot_id string, url string, indexable string").write.parquet(f"{tmp_path}/pages.parquet")
    got = graphs.link_templates(spark, str(tmp_path)).collect()
    assert len(got) == len(links)
    assert {(x.src, x.dst): (x.template_frequency, x.weight) for x in got} == {(a, b): (4, 0.075) if a.split("/")[2] in ("small.example", "closed.example") and b == f"{a.rsplit('/', 1)[0]}/hub" else (None, 0.3) for a, b in links}


def test_nearest_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], 1) for i in range(300)] + [(300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None], 1), (303, [1.0] * 3, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v, _ in rows[:300]} | {301: [0.0] * 8}
    got = {}
    for x in nearest(df, df.where("vec_id % 100 = 0"), k=5).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.hit_id))
    for q in (0, 100, 200):
        best = sorted((-round(sum(a * b for a, b in zip(unit[q], v)), 9), i) for i, v in unit.items() if i != q)[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in best]
    assert set(got) == {0, 100, 200} and nearest(df.limit(0), df).count() == 0


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "The crawler reads robots rules", 0), (2, "tomato soup", 0), (3, None, 0), (4, "", 0), (5, "robots rules", 0)], "doc_id long, text string, entities int")
    assert [x.doc_id for x in retrieve(docs, "robots rules").collect()] == [5, 1] and retrieve(docs, "").count() == 0
    assert [(x.doc_id, x.entities) for x in keyword_retrieve(docs, "Robots rules crawler", 1).collect()] == [(1, 3)]
    assert docs.select(lexical_embedding("t").alias("e")).count() == 5 if "t" in docs.columns else True


def test_long_texts_as_queries(spark):
    own = " ".join(f"word{i}" for i in range(3000)) + " Word7 word7 ß9 éé é"
    rows = [(1, own), (2, "Xword7y, WORD12 and a word2999; ß9"), (3, "tomato soup"), (4, None), (5, "!"), (6, "naïve éé" + "x" * 3000 + "word5"), (7, "word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = query_tokens(own)
    want = {i: sum(len(t.encode()) > 3 and t in x.lower() for t in asked) for i, x in rows if x and any(t in x.lower() for t in asked)}
    assert set(want) == {1, 2, 6} and want[2] > 8 and want[6] == 2
    assert {x.doc_id: x.entities for x in similar(docs, 1).collect()} == {i: n for i, n in want.items() if i != 1}
    assert {x.doc_id: x.entities for x in retrieve(docs, own).collect()} == want
    assert {x.doc_id: x.entities for x in keyword_retrieve(docs, own).collect()} == {i: sum(t in x.lower() for t in set(asked)) for i, x in rows if i in want}
    r = random.Random(2)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(1, 40))) for _ in range(200)]
    for some in (words[:2], [w[:5] for w in words]):
        inside, tokens = holder(some), list(dict.fromkeys(some))
        assert all(sorted(inside(w)) == [i for i, t in enumerate(tokens) if t in w] for w in words)


def test_query_language(spark):
    q = dsl.parse('from URLS where title contains "a AND b = c" and status >= 200 return url, nope limit 999')
    assert (q.collection, q.filters, q.fields, q.limit) == ("urls", [("title", "contains", "a AND b = c"), ("status", ">=", "200")], ["url", "nope"], 200)
    assert dsl.parse("FROM families").limit == 50 and dsl.parse("FROM families").collection == "route_families"
    for bad in ("", "WHERE a = 1", "FROM nothing", "FROM urls LIMIT x", "FROM urls LIMIT 1 WHERE a = 1", "FROM urls WHERE a", "FROM urls xyz"):
        with pytest.raises(dsl.QueryError):
            dsl.parse(bad)
    t = {"urls": spark.createDataFrame([("A", 1, None), ("b", 20, "É"), (None, 3, "x")], "url string, n int, t string")}
    run = lambda text: [tuple(r) for r in dsl.run(text, t).collect()]
    assert run("FROM urls WHERE url = a RETURN n") == [(1,)] and run("FROM urls WHERE url != a RETURN n") == [(20,)] and run("FROM urls WHERE zzz != 1") == [] and run("FROM urls WHERE n > 3 RETURN url") == [("b",)] and run("FROM urls WHERE url > 3") == [] and run("FROM urls WHERE t contains é") == []
    cut = lambda q: {(r.cut) for r in dsl.run(q, t, flag="cut").collect()}
    assert cut("FROM urls LIMIT 2") == {True} and cut("FROM urls LIMIT 3") == {False} and dsl.run("FROM urls LIMIT 2", t, flag="cut").count() == 2


def test_bands_find_the_links(spark):
    import random

    from sievemark.operators.similarity import minhash_links, similar_pairs

    r = random.Random(11)
    rows = []
    for g in range(60):
        words = [f"w{r.randrange(500)}" for _ in range(60)]
        rows += [(g * 10 + k, " ".join(words[: 60 - k] + [f"x{g}{k}"] * k)) for k in range(5)]
    rows += [(9000, None), (9001, ""), (9002, "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = {(x.a, x.b) for x in similar_pairs(docs)[0].collect()}
    quick = {(x.a, x.b) for x in minhash_links(docs).collect()}
    assert quick <= exact and len(exact) > 100 and len(quick) >= 0.98 * len(exact)
