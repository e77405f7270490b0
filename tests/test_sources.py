import json
from datetime import datetime

from sievemark.operators import observations as O
from sievemark.sources import history_store
from sievemark.sources.imports import log_hits, observations_of, read_imports
from sievemark.streaming import events as E


def test_imports(spark, tmp_path):
    good = {"provider": "gsc", "rows": [{"query": "q", "url": "u", "clicks": 3}, None, {"kind": "bot", "hits": 2}, {"provider": "logs"}], "keywords": [{"query": "k", "search_volume": 5}], "prompts": [{"prompt": "p", "platform": "x", "cited_urls": ["a", "b"]}, {"prompt": "r", "cited_urls": []}]}
    for name, body in {"a": "﻿" + json.dumps(good), "b": "{broken", "c": '{"provider": "gsc", "rows": []}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    files = read_imports(spark, str(tmp_path))
    assert sorted(r.input_state for r in files.collect()) == ["connected", "empty", "invalid"]
    got = sorted((r.kind, r.query or "", r.url or "", r.provider) for r in observations_of(files).collect())
    assert got == [("ai_citation", "p", "a", "gsc"), ("ai_citation", "p", "b", "gsc"), ("ai_prompt", "r", "prompt:", "gsc"), ("bot_crawl", "", "", "gsc"), ("bot_crawl", "", "", "logs"), ("keyword_volume", "k", "", "gsc"), ("search_performance", "q", "u", "gsc")]


def test_log_lines(spark):
    line = '1.2.3.4 - - [25/Mar/2026:20:06:07 +0000] "GET /p HTTP/1.1" 404 99 "-" "{}"'
    lines = [line.format("MirloBot/2"), line.format("mirlobot"), line.format("Mozilla"), line.format("some spider"), "# comment", "", "broken", None]
    df = spark.createDataFrame([("https://e.com/", lines, None), ("https://f.com", None, line.format("mirlobot") + "\n"), (None, None, None)], "origin string, lines array<string>, log string")
    got = log_hits(df, spark.createDataFrame([("mirlobot", "training")], "token string, role string")).collect()
    assert {(r.url, r.bot_role, r.status, r.hits) for r in got} == {("https://e.com/p", "training", 404, 2), ("https://e.com/p", "other", 404, 1), ("https://f.com/p", "training", 404, 1)}


def test_snapshots_replace_only_themselves(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "snapshot_id string, url string")
    history_store.save({"pages": rows(("a", "1"), ("b", "1"))}, str(tmp_path))
    history_store.save({"pages": rows(("b", "2"))}, str(tmp_path))
    assert sorted((r.snapshot_id, r.url) for r in history_store.load(spark, str(tmp_path), "pages").collect()) == [("a", "1"), ("b", "2")]
    assert [r.url for r in history_store.load(spark, str(tmp_path), "pages", "b").collect()] == ["2"]


def test_streams(spark, tmp_path):
    t = lambda h: datetime(2026, 1, 1 + h // 24, h % 24)
    rows = [(1, t(0), 7, "view", 1.0), (1, t(0), 7, "view", 1.0), (2, t(2), 7, "click", 2.0), (3, t(20), 7, "view", None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = E.first_deliveries(E.read_events(spark, str(tmp_path / "in")))
    q = E.upsert_partitions(stream, str(tmp_path / "out"), str(tmp_path / "check"), "event_type")
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in E.sessions(batch).collect()) == [1, 3] and E.windowed_counts(batch).count() == 14


def test_observation_rules_fire_and_stay_quiet(spark):
    rows = [
        (1, "search_performance", "roof repair", "https://e.com/a/x/", 40, 800, 0, 3.0, "prior month", None, None, None), (2, "search_performance", "roof repair", "https://e.com/a/x/", 8, 700, 0, 8.0, None, None, None, None),
        (3, "search_performance", "roof repair", "https://e.com/a/y", 9, 90, 0, 12.4, "2026-01-01", None, None, None), (4, "bot_crawl", None, "https://e.com/gone", None, None, 25, None, None, None, 404, "search_discovery"),
        (5, "bot_crawl", None, "https://e.com/closed", 0, 0, 30, None, None, None, 200, "training"), (6, "ai_citation", "p", "https://e.com/a/x", 0, 0, 0, None, "previous", None, None, None), (7, "ai_citation", "p", "https://e.com/other", 0, 0, 0, None, None, None, None, None), (8, None, None, None, None, None, None, None, None, None, None, None),
    ]
    obs = spark.createDataFrame([(*r[:4], "gsc", *r[4:], datetime(2026, 1, 1), "own") for r in rows] + [(3, "search_performance", "old", "old", "gsc", 0, 0, 0, None, None, None, None, None, datetime(2025, 1, 1), "own")], "row_id long, kind string, query string, url string, provider string, clicks long, impressions long, hits long, position float, period string, user_agent string, status int, bot_role string, loaded_at timestamp, page_url string")
    r = O.current_rows(obs)
    pages = spark.createDataFrame([("https://e.com/a/x", "indexable", 1), ("https://e.com/closed", "noindex", 0), ("https://e.com/a/y/", "indexable", 0)], "url string, indexable string, inbound int")
    assert [(x.url, x.clicks_before, x.clicks_after, x.delta_pct) for x in O.decay(r).collect()] == [("https://e.com/a/x/", 40, 8, -80)]
    assert {(x.query, x.page_url, x.n_urls, x.action) for x in O.query_cannibalization(r).collect()} == {("roof repair", u, 2, "CONSOLIDATE") for u in ("https://e.com/a/x", "https://e.com/a/y")}
    assert {(x.row_id, x.code) for x in O.bot_findings(r, pages).collect()} == {(4, "SE-OBS-007"), (5, "SE-OBS-008"), (5, "SE-OBS-009")}
    assert {x.row_id for x in O.ctr_gaps(r).collect()} == {2} and {x.row_id for x in O.striking_distance(r, pages).collect()} == {2, 3} and O.demand_without_page(r, pages).count() == 0 and O.demand_without_bots(r, pages).count() == 3
    axes = {x.page_url: (x.demand, x.visibility_gap) for x in O.demand_axes(r).collect()}
    assert axes["https://e.com/a/y"] == (9, 12) and [(x.query, x.url) for x in O.citation_drops(r).collect()] == [("p", "https://e.com/a/x")]
    funnel = {x.url: (x.discovery_hits, x.citation_hits, x.uncited) for x in O.ai_funnel(r).collect()}
    assert funnel["https://e.com/gone"] == (25, None, True) and O.url_metrics(r.limit(0)).count() == 0 and {x.name: x.value for x in O.outcome_metrics(r.limit(0)).collect()}["search_clicks"] is None
