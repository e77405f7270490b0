import random
from datetime import datetime, timedelta

import pytest

from sievemark.operators.references import orphan_counts, orphan_references

T0 = datetime(2026, 1, 1)
REFS = "n long, ref string, at timestamp, state string, id string"
NODES = "id string, loaded_at timestamp, deleted_at timestamp, ref string"


def run(spark, refs, nodes, **kw):
    r, n = spark.createDataFrame([(*x, "old", "own") for x in refs], REFS), spark.createDataFrame([(*x, "r") for x in nodes], NODES)
    return {(x.n, x.state) for x in orphan_references(r, n, "ref", "at", "id", "loaded_at", "deleted_at", **kw).collect()}


def brute(refs, nodes):
    out = set()
    for n, ref, at in refs:
        if not ref or at is None:
            continue
        mine = [(a, b) for i, a, b in nodes if i == ref and a is not None]
        if not any(a <= at and (b is None or at < b) for a, b in mine):
            out.add((n, "missing" if not mine else "late" if all(a > at for a, _ in mine) else "deleted"))
    return out


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_against_brute_force(spark, most):
    r = random.Random(3)
    t = lambda: T0 + timedelta(hours=r.randrange(200))
    ids = ["hot", *"abcdefgh"]
    nodes = [(r.choice(ids + [None, ""]), r.choice([None, t(), t(), t()]), r.choice([None, t()])) for _ in range(60)]
    refs = [(i, r.choice(["hot"] * 4 + ids + ["zz", None, "", " a"]), r.choice([t(), t(), t(), None])) for i in range(300)]
    got = run(spark, refs, nodes, most=most)
    assert got == brute(refs, nodes) and {s for _, s in got} == {"missing", "late", "deleted"}


def test_heavy_keys_and_long_lives_take_their_paths(spark):
    many = [("long", T0 + timedelta(hours=2 * k), T0 + timedelta(hours=2 * k + 1)) for k in range(150)]
    refs = [(i, k, T0 + timedelta(hours=i % 40)) for i, k in enumerate(["hot"] * 50 + ["long"] * 40 + ["rare"] * 2 + ["one"])]
    r, n = spark.createDataFrame([(*x, "old", "own") for x in refs], REFS), spark.createDataFrame([(*x, "r") for x in [*many, ("one", T0, None)]], NODES)
    got = orphan_references(r, n, "ref", "at", "id", "loaded_at", "deleted_at", most=2).collect()
    # the second key is heavy too, but has more lifetimes than the broadcast takes
    assert {(x.ref, x.path) for x in got} == {("hot", "heavy"), ("long", "light"), ("rare", "light")} and {(x.n, x.state) for x in got} == brute(refs, many + [("one", T0, None)])


def test_edges_of_a_lifetime_and_repeats(spark):
    nodes = [("a", T0, T0 + timedelta(1)), ("a", T0, T0 + timedelta(1)), ("a", T0 + timedelta(1), T0 + timedelta(2))]
    refs = [(1, "a", T0), (2, "a", T0 + timedelta(1)), (3, "a", T0 + timedelta(2)), (4, "a", T0 - timedelta(1)), (5, "A", T0)]
    assert run(spark, refs, nodes) == {(3, "deleted"), (4, "late"), (5, "missing")}


def test_empty_and_counts(spark):
    assert run(spark, [], []) == set()
    refs = spark.createDataFrame([(1, "a", T0, "s", "k"), (2, "b", T0, "s", None), (3, "b", T0 + timedelta(40), "s", "k")], REFS)
    nodes = spark.createDataFrame([("b", T0 + timedelta(30), None, "r")], NODES)
    assert {tuple(r) for r in orphan_counts(refs.union(refs), nodes, ["id"], "ref", "at", "id", "loaded_at", "deleted_at").collect()} == {("k", "2026-01", 1, 1, 0, 0), (None, "2026-01", 1, 0, 0, 1), ("k", "2026-02", 1, 0, 0, 0)}
