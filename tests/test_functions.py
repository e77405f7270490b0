import pytest
from pyspark.sql import functions as F

from sievemark.functions import hashing as H
from sievemark.functions import measures as M
from sievemark.functions import text as X
from sievemark.functions import urls as U
from sievemark.operators.vectors import lexical_embedding, slot_of


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTPS://Example.com:443/a/./b/../c/?x=1#top", "https://example.com/a/c/?x=1"), ("http://example.com", "http://example.com/"), ("http://example.com:8080//a//", "http://example.com:8080/a/"),
        ("http://[::1]:80/x", "http://[::1]/x"), ("https://e.com/foo", "https://e.com/foo"), ("https://e.com/foo/", "https://e.com/foo/"), ("https://e.com/?", "https://e.com/"), ("https://u:p@e.com/", None), ("ftp://e.com/", None),
        ("https://e.com:99999/", None), ("/a", None), ("", None), (None, None), ("https://e.com/..", "https://e.com/"),
    ],
)
def test_url_identity(spark, raw, want):
    assert one(spark, raw, U.canonical_url) == want


@pytest.mark.parametrize(
    "href, want",
    [("?q=2", "https://e.com/a/b?q=2"), ("c", "https://e.com/a/c"), ("/d", "https://e.com/d"), ("//f.com/x", "https://f.com/x"), ("#t", None), ("mailto:x", None), ("javascript:0", None), ("", None), ("http://g.com", "http://g.com/"), ("../z#k", "https://e.com/z")],
)
def test_join(spark, href, want):
    assert one(spark, href, lambda h: U.join_url(F.lit("https://e.com/a/b?x=1"), h)) == want


def test_path_shapes(spark):
    assert tuple(one(spark, "/en/services/roof/port-lisette", U.city_family)) == ("category/roof", "port-lisette") and one(spark, "/services/roof", U.city_family) is None
    assert one(spark, "a=1&b=2&a=3&c", lambda q: F.array(U.query_value(q, "a"), U.query_value(q, "c"), U.query_value(q, "z"))) == ["1", "", None]
    assert [one(spark, h, U.is_public_host) for h in ("example.com", "127.0.0.1", "10.1.2.3", "100.64.0.1", "169.254.169.254", "8.8.8.8", "localhost", "x.internal", "::1", "fd00::1")] == [True, False, False, False, False, True, False, False, False, False]
    glob = lambda g, p: one(spark, p, lambda c: c.rlike(U.glob_regex(g)))
    assert glob("/a/*/c", "/a/b/c") and not glob("/a/*/c", "/a/b/d/c") and glob("/a/**", "/a") and glob("/:locale/x", "/x") and glob("/:locale/x", "/en/x") and not glob("/x", "/x/y")
    route = lambda g, p: one(spark, p, lambda c: c.rlike(U.route_regex(g)))
    assert route("/blog/:slug", "/blog/a/") and route("/docs/*rest", "/docs/a/b") and not route("/blog/:slug", "/blog")


def test_tokens_sentences_and_shares(spark):
    assert one(spark, "Licensed É x Électricien, in 98682!", X.tokens) == ["licensed", "É", "Électricien", "in", "98682"]
    assert one(spark, "One two three. No. Is it so? tail of text", X.sentences) == ["One two three.", "Is it so?", "tail of text"]
    assert one(spark, "", X.tokens) == [] and one(spark, None, X.tokens) is None and one(spark, "", X.sentences) == []
    assert one(spark, ["a", "b", "c", "d"], lambda t: X.shingles(t, 3), "array<string>") == ["a b c", "b c d"] and one(spark, ["a"], lambda t: X.shingles(t, 3), "array<string>") == ["a"]
    assert one(spark, 1, lambda v: F.array(X.share(v, F.lit(3)), X.share(v, F.lit(0)), X.share(v * 9, F.lit(3))), "int") == [33, None, 100]
    assert one(spark, "Call WA-now", lambda t: X.contains_token(t, "wa")) and not one(spark, "await", lambda t: X.contains_token(t, "wa")) and one(spark, "שלום", X.contains_hebrew)
    assert one(spark, " A\n b c ", X.compact) == "abc" and one(spark, " A\n b ", X.collapse) == "A b"


def test_hashes(spark):
    known = {"electrician": "b8c83e0d95355b2283a1412a0c1a2db6", "city": "697f5ed344757277b806e97b419937fa", "é": "088093bf9eab1be95aa0733054c70821", "": "6c62272e07bb014262b821756295c58d"}
    df = spark.createDataFrame([(k,) for k in known], "v string")
    assert {r.v: r.a for r in df.select("v", H.hash_of(F.col("v")).alias("a")).collect()} == known == {k: f"{H.fnv(k.encode()):032x}" for k in known}
    slots = {"electrician": (8, -1), "haifa": (63, 1), "licensed": (6, 1), "price": (6, -1)}
    assert {k: slot_of(k) for k in slots} == slots
    vectors = spark.createDataFrame([(["price", "licensed", "price"],), ([],), (None,), (["haifa"],)], "t array<string>").select(lexical_embedding("t").alias("v")).collect()
    assert [None if r.v is None else {i: x for i, x in enumerate(r.v) if x} for r in vectors] == [{6: -1.0}, None, None, {63: 1.0}]
    sig = spark.createDataFrame([([1, 2, 3],), ([],)], "h array<bigint>").select(H.minhash(F.col("h")).alias("m")).collect()
    assert len(sig[0].m) == 64 and sig[1].m is None
    assert one(spark, [1, 2, 3], lambda h: H.estimated_similarity(H.minhash(h), H.minhash(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), F.lit(3).cast("bigint")))), "array<bigint>") == 100
    assert len(one(spark, [1, 2, 3], lambda h: H.bands(H.minhash(h)), "array<bigint>")) == 16 and len(H.exact_minhash(["a", "b"])) == 64


def test_measures(spark):
    assert one(spark, 12.4, lambda p: M.position_gap(p), "double") == 12 and one(spark, 500, M.demand, "int") == 50
    assert one(spark, 8, lambda v: F.array(M.percent_delta(v, F.lit(40)), M.percent_delta(v, F.lit(0)), M.percent_delta(F.lit(10), F.lit(3))), "int") == [-80, None, 233]
    assert one(spark, 100, lambda i: M.recoverable_clicks(i, F.lit(3), F.lit(1.0)), "int") == 25
    assert one(spark, 10, lambda c: M.expected_value(c, F.lit(None).cast("int"), F.lit(55), F.lit(None).cast("int")), "int") == 550
    assert one(spark, [1.0, 0.0], lambda v: F.array(M.cosine(v, v), M.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))), "array<double>") == [1.0, 0.0]
    ranks = spark.sql("SELECT * FROM VALUES (60, 10), (60, NULL), (NULL, 10), (NULL, NULL), (20, 10), (60, 90) AS t(c, r)").select(M.trust_rank(F.col("c"), F.col("r")).alias("t")).collect()
    assert [r.t for r in ranks] == [3, 2, 2, 1, 0, 0]
