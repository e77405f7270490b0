import json

import pytest

from sievemark.__main__ import NotAllowed, allowed_path, main
from sievemark.sources import reports as RP

ROWS = [("A", "A:1", "error", "u1", "s"), ("B", "B:1", "warn", "u<2>", "s"), ("A", "A:2", "error", "u3", None), (None, None, None, None, None)]


def test_reports_are_written_and_read(spark, tmp_path):
    f = spark.createDataFrame(ROWS, RP.FINDING)
    assert [tuple(r) for r in RP.summary(f.where("code IS NOT NULL")).collect()] == [("error", "A", 2), ("warn", "B", 1)]
    assert "u3" in RP.render_text(f.where("code IS NOT NULL")) and "u&lt;2&gt;" in RP.render_html(f.where("code IS NOT NULL")) and RP.render_text(f.limit(0)).strip() == ""
    RP.write_findings(f, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    d = tmp_path / "in"
    d.mkdir()
    page, finding = {"url": "u", "status": 200}, {"code": "A", "fingerprint": "A:1", "severity": "error", "url": "u"}
    (d / "a.json").write_text("﻿" + json.dumps({"snapshot_id": "s1", "pages": [page], "findings": [finding]}))
    (d / "b.json").write_text(json.dumps({"inventory": {"snapshot_id": "s2", "pages": [page, page]}, "findings": [{**finding, "severity": "warn"}]}))
    (d / "c.json").write_text("{")
    pages, findings = RP.load_snapshots(spark, str(d))
    assert sorted((r.snapshot_id, r.status) for r in pages.collect()) == [("s1", 200), ("s2", 200), ("s2", 200)] and sorted((r.snapshot_id, r.severity) for r in findings.collect()) == [("s1", "error"), ("s2", "warn")]
    (d / "base.json").write_text(json.dumps({"fingerprints": ["X:1", "X:1"]}))
    assert {r.fingerprint for r in RP.load_baseline(spark, str(d)).collect()} == {"A:1", "X:1"}
    assert [tuple(r) for r in RP.error_codes(spark.createDataFrame([("s", "error", "B"), ("s", "error", "A"), ("s", "warn", "C")], "snapshot_id string, severity string, code string"), 1).collect()] == [("s", ["A"])]


def test_paths_outside_the_roots_are_refused(tmp_path):
    (tmp_path / "in").mkdir()
    assert allowed_path(str(tmp_path / "in" / ".." / "in"), [str(tmp_path)]) == str((tmp_path / "in").resolve())
    with pytest.raises(NotAllowed):
        allowed_path(str(tmp_path / "in" / ".." / ".."), [str(tmp_path / "in")])
    (tmp_path / "link").symlink_to("/")
    with pytest.raises(NotAllowed):
        allowed_path(str(tmp_path / "link" / "etc"), [str(tmp_path)])


def test_command_line(spark, tmp_path, capsys):
    assert main(["nothing"]) == 2 and main(["query", "--tables", str(tmp_path), "--root", "/nowhere"]) == 2
    assert main(["query", "--tables", str(tmp_path), "--q", "FROM"]) == 1
    df = spark.createDataFrame([("s1", "https://a/", "live", 3, 0)], "snapshot_id string, site string, mode string, measured_urls int, findings int")
    df.write.parquet(str(tmp_path / "runs.parquet"))
    assert main(["query", "--tables", str(tmp_path), "--q", "FROM runs RETURN site"]) == 0 and '{"site":"https://a"}' in capsys.readouterr().out


def test_axes_and_comparable_runs(spark):
    from pyspark.sql import functions as F

    from sievemark.operators.history import AXES, axis_scores, comparable

    f = spark.createDataFrame([("CRAWL", "error"), ("CRAWL", "warn"), ("META", "info"), (None, None)], "family string, severity string")
    got = {r.axis: (r.errors, r.warnings, r.infos, r.unmeasured) for r in axis_scores(f, http=False, rendered=False, cited=False).collect()}
    assert len(got) == len(AXES) == 18 and got["technical_discoverability"] == (1, 1, 0, False) and got["security"] == (0, 0, 0, True) and got["ai_visibility"][3] and got["render_reconciliation"][3] and not got["observed_search"][3]
    kind = "struct<origin:string,mode:string,version:string,rules:string,config:string>"
    rows = [(("o", "site", "1", "r", ""), ("o", "hybrid", "1", None, "c"), True), (("o", "site", "1", "r", "c"), ("o", "repo", "1", "r", "c"), False), (("o", None, "1", "r", "c"), ("p", "x", "1", "r", "c"), False), ((None,) * 5, ("p", "x", "1", "r", "c"), True)]
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", comparable(F.col("a"), F.col("b"))).collect())


def test_sitemaps_payload_and_imports(spark, tmp_path):
    import gzip

    from pyspark.sql import functions as F

    from sievemark.functions import urls as U
    from sievemark.sources.html import extract
    from sievemark.sources.imports import agent_of, import_findings, read_imports, read_rendered
    from sievemark.sources.robots import SITEMAPS, sitemap_candidates, sitemap_urls, unpacked

    files = spark.createDataFrame([("https://a.x/", "User-agent: *\nSitemap: https://a.x/s.xml # x\n sitemap:https://a.x/t.xml"), ("https://b.x", None), (None, "x")], "origin string, body string")
    assert {(r.origin, r.loc) for r in sitemap_candidates(files).collect()} == {("https://a.x/", "https://a.x/s.xml"), ("https://a.x/", "https://a.x/t.xml")} | {("https://b.x", f"https://b.x{p}") for p in SITEMAPS}
    xml = b"<urlset><url><loc>https://a.x/1</loc></url></urlset>"
    packed = spark.createDataFrame([(bytearray(gzip.compress(xml)),), (bytearray(xml),), (bytearray(b"\x1f\x8bbroken"),), (None,)], "content binary")
    assert [r.loc for r in sitemap_urls(unpacked(packed)).collect()] == ["https://a.x/1"]
    page = spark.createDataFrame([('<script type="application/json">{"a": 1}</script><p>Text here</p><script>var x</script>',)], "h string").select(extract("h").alias("p")).first().p
    assert page.payload == '{"a": 1}' and page.text == "Text here"
    (tmp_path / "r.json").write_text('{"pages": [{"url": "u", "json_ld_types": ["A"]}, {"title": "x"}, null]}')
    assert [(r.url, r.json_ld_types) for r in read_rendered(spark, str(tmp_path)).collect()] == [("u", ["A"])]
    (tmp_path / "s.json").write_text("{")
    assert [r.code for r in import_findings(read_imports(spark, str(tmp_path))).collect()] == ["SE-OBS-003"]
    ua = spark.createDataFrame([("Googlebot +google.com/bot.html",), ("Google-Extended googlebot",), ("mirlobot-news x",), ("some spider",), ("Mozilla",), (None,)], "u string")
    got = [None if r.a is None else tuple(r.a) for r in ua.select(agent_of(F.col("u"), [("mirlobot", "training"), ("mirlobot-news", "search_discovery")]).alias("a")).collect()]
    assert got == [("googlebot", "search_discovery", True), ("unknown-bot", "other", False), ("mirlobot-news", "search_discovery", True), ("unknown-bot", "other", False), None, None]
    u = spark.createDataFrame([("https://a.x:443/p?q=1", "https://A.x/z"), ("http://a.x/p", "https://a.x/p")], "a string, b string")
    assert [(r.s, r.t) for r in u.select(U.same_origin(U.url_parts(F.col("a")), U.url_parts(F.col("b"))).alias("s"), U.request_target(U.url_parts(F.col("a"))).alias("t")).collect()] == [(True, "/p?q=1"), (False, "/p")]
