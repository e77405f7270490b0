import os
import random

import pytest

from sievemark.llm.packing import _Stock, attach_text, best_fit, pack_documents, plan_containers, reduce_by_dominance
from sievemark.llm.tokens import VOCABULARY, encoding

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


def fewest(sizes, capacity):
    """Exact bin packing by search, for a few items."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[i]:
                j = bins.index(room)
                go(i + 1, [*bins[:j], room - sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_loses_no_optimum():
    for seed in range(150):
        r = random.Random(seed)
        sizes, capacity = [r.randrange(3, 30) for _ in range(r.randrange(1, 10))], 30
        counts = {s: sizes.count(s) for s in sizes}
        stock = _Stock(counts)
        fixed = reduce_by_dominance(stock, capacity)
        rest = [s for s, n in stock.count.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity), sizes
        packed = fixed + best_fit(stock, capacity)
        used = {}
        for n, pattern in packed:
            assert n > 0 and sum(s * k for s, k in pattern) <= capacity
            for s, k in pattern:
                used[s] = used.get(s, 0) + n * k
        assert used == counts


def test_many_items_stay_near_the_bound():
    r = random.Random(0)
    counts = {}
    for _ in range(50_000):
        s = min(512, max(1, int(r.lognormvariate(5, 0.9))))
        counts[s] = counts.get(s, 0) + 1
    plan = plan_containers(counts, 512)
    assert sum(n for n, _ in plan) <= 1.005 * sum(s * n for s, n in counts.items()) / 512
    with pytest.raises(ValueError):
        plan_containers({513: 1}, 512)


@needs_vocabulary
def test_documents(spark):
    r = random.Random(1)
    words = ["audit", "Überschrift", "💡", "naïve", "été", "x" * 30]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(200)] + ["same text"] * 90 + [None, "", " ", "é💡" * 20_000]
    docs = spark.createDataFrame([(i, t, 5, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int, size int")
    specs = spark.createDataFrame([(1, 50), (1, 50), (2, 700), (3, 0), (4, None)], "spec_id int, capacity_tokens int")
    packed = pack_documents(docs, specs, buckets=3)
    rows = attach_text(packed, docs).collect()
    size = [len(encoding().encode_ordinary(t or "")) for t in texts]
    for spec, capacity in ((1, 50), (2, 700)):
        mine = [x for x in rows if x.spec_id == spec]
        assert {x.doc_id for x in mine} == set(range(len(texts)))
        fill, whole = {}, {}
        for x in sorted(mine, key=lambda x: (x.doc_id, x.piece)):
            if x.container_id is None:
                assert size[x.doc_id] == 0
                continue
            fill[x.container_id] = fill.get(x.container_id, 0) + x.n_tokens
            whole.setdefault(x.doc_id, []).append(x)
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert len(fill) <= 1 + 1.05 * sum(fill.values()) / capacity
        for d, xs in whole.items():
            n = sum(x.n_tokens for x in xs)
            assert n == size[d] and (len(xs) == 1 or n > capacity) and all(x.n_tokens == capacity for x in xs[:-1])
            assert "".join(x.text for x in xs) == texts[d]
    assert {x.spec_id for x in rows} == {1, 2}


@needs_vocabulary
def test_empty(spark):
    docs, specs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 9)], "spec_id int, capacity_tokens int")
    assert pack_documents(docs, specs).count() == 0
    assert pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), specs.limit(0)).count() == 0
