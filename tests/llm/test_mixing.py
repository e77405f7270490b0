import os
from collections import Counter

import numpy as np
import pytest

from sievemark.llm import mixing
from sievemark.llm.mixing import mix_sources, permute, plan_shares, shard_counts
from sievemark.llm.queries import QUERIES
from sievemark.llm.tokens import VOCABULARY

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 1000])
def test_permute_is_one_to_one(n):
    assert sorted(permute(np.arange(n), n, 5).tolist()) == list(range(n))
    assert n < 60 or permute(np.arange(n), n, 5).tolist() != permute(np.arange(n), n, 6).tolist()


def test_shard_counts_add_up_to_the_totals():
    totals, size = np.array([500, 0, 33, 1700, 1]), 100
    n = -(-int(totals.sum()) // size)
    seen = np.zeros_like(totals)
    for s in range(n):
        counts, before = shard_counts(totals, s, n, size, 3)
        assert (before == seen).all() and counts.sum() == (size if s < n - 1 else totals.sum() - size * (n - 1))
        seen = seen + counts
    assert (seen == totals).all()


def test_plan_shares():
    p = {x.source: x for x in plan_shares([("a", 0.5, 1, 100), ("b", 0.3, 2, 200), ("tiny", 0.1, 3, 1), ("none", 0.1, 5, 0)], 0.8)}
    assert (p["tiny"].drawn, p["none"].drawn, p["a"].drawn) == (3, 0, 100) and p["b"].drawn == 60
    q = {x.source: x.drawn for x in plan_shares([("a", 0.5, 1, 100), ("b", 0.3, 2, 200), ("tiny", 0.1, 3, 1), ("none", 0.1, 5, 0)], 1.0)}
    assert q == {"a": 15, "b": 9, "tiny": 3, "none": 0}
    assert plan_shares([], 0.8) == []


@needs_vocabulary
def test_mix(spark):
    rows = [(i, f"text number {i} " * (1 + i % 7), s) for i, s in enumerate(["Big_one"] * 300 + [" mid"] * 80 + ["small"] * 3 + ["other", None, ""])] + [(900, None, "mid"), (901, "", "mid"), (902, "word " * 20_000, "big-one")]
    docs = spark.createDataFrame([(*r, 1, "own") for r in rows], "doc_id long, text string, source string, start int, block_no string")
    weights = spark.createDataFrame([("big-one", 0.6, 1), ("mid", 0.3, 2), ("small", 0.08, 3), ("absent", 0.02, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(docs, weights, block=16, shard=50, buckets=4)
    m, rep = mix.collect(), {r.source: r for r in report.collect()}
    cap = {"big-one": 1, "mid": 2, "small": 3}
    assert set(rep) == {"big-one", "mid", "small", "absent"} and rep["absent"].drawn_tokens == 0
    total = sum(r.n_tokens for r in m)
    for s, n in Counter({s: sum(r.n_tokens for r in m if r.source == s) for s in cap}).items():
        assert rep[s].drawn_tokens == n and abs(rep[s].actual_share - n / total) < 1e-6
    assert abs(rep["big-one"].actual_share / rep["mid"].actual_share - 2) < 0.05
    used = Counter((r.source, r.doc_id, t) for r in m for t in range(r.token_start, r.token_start + r.n_tokens))
    assert all(n <= cap[s] for (s, _, _), n in used.items())
    again = mix_sources(docs.repartition(7), weights, block=16, shard=50, buckets=4)[0].collect()
    assert sorted(map(tuple, m)) == sorted(map(tuple, again))
    slots = {(r.shard, r.slot) for r in m}
    assert len({s for s, _ in slots}) == -(-len(slots) // 50)


@needs_vocabulary
def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(docs, weights)
    assert mix.count() == 0 and [r.drawn_tokens for r in report.collect()] == [0]


@needs_vocabulary
def test_first_query_meets_the_shares(spark, tmp_path):
    sizes = {"large": (0.6, 400), "middle": (0.3, 200), "few": (0.1, 8)}
    docs = [(i, f"text number {i} " * 60, s) for i, s in enumerate(s for s, (_, n) in sizes.items() for _ in range(n))]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(s, w, 2) for s, (w, _) in sizes.items()], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/source_weights.parquet")
    mix = QUERIES[next(k for k in QUERIES if k.startswith("p8_"))](spark, str(tmp_path)).groupBy("source").sum("n_tokens").collect()
    total = sum(r[1] for r in mix)
    assert all(abs(r[1] / total - sizes[r[0]][0]) < 0.01 for r in mix) and len(mix) == 3


def test_large_totals_are_drawn_too(monkeypatch):
    totals, size = np.array([3 * 10**9, 5, 2 * 10**9 - 5]), 10**9
    drawn = [[shard_counts(totals, s, 5, size, seed)[0] for s in range(5)] for seed in range(20)]
    assert all((sum(d) == totals).all() and all(x.sum() == size and (x >= 0).all() for x in d) for d in drawn)
    assert len({int(d[0][0]) for d in drawn}) == 20
    monkeypatch.setattr(mixing, "EXACT_BELOW", 0)
    few = np.array([600, 3, 397])
    got = np.array([shard_counts(few, 0, 2, 500, seed)[0] for seed in range(3000)])
    mean, var = 500 * few / 1000, 500 * few / 1000 * (1 - few / 1000) * 500 / 999
    assert (abs(got.mean(0) - mean) < 5 * (var / 3000) ** 0.5).all() and (abs(got.var(0) / var - 1) < 0.15).all()
