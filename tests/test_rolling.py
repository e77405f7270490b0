import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from sievemark.operators.rolling import build_trees, correct_trees, rolling_totals

SCHEMA = "k string, d date, a long, b long, clicks_total long"


def brute(rows, windows):
    by = {}
    for k, d, a, b, *_ in rows:
        if k is None or d is None:
            continue
        x = by.setdefault(k, {}).setdefault(d, [0, 0])
        x[0] += a or 0
        x[1] += b or 0
    out = set()
    for k, days in by.items():
        d = min(days)
        while d <= max(days):
            for w in windows:
                back = lambda e, i: sum(days.get(e - timedelta(j), [0, 0])[i] for j in range(w))  # noqa: E731, B023
                out.add((k, d, w, back(d, 0), back(d - timedelta(1), 0), back(d, 1)))
            d += timedelta(1)
    return out


def rows(seed, n=160):
    r = random.Random(seed)
    return [(r.choice(["u", "v", "w", ""]), date(2026, 1, 1) + timedelta(r.choice([r.randrange(40), 100 + r.randrange(200)])), r.choice([None, 0, 3, 7]), r.randrange(5), 1) for _ in range(n)] + [(None, date(2026, 1, 1), 1, 1, 1), ("u", None, 1, 1, 1), ("lone", date(2026, 5, 5), 0, 0, 1)]


def daily(spark, data):
    return spark.createDataFrame(data, SCHEMA).groupBy("k", "d").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def answers(trees, windows):
    out = rolling_totals(trees, "k", ["a", "b"], windows).collect()
    assert all(abs(r.a_avg - r.a_total / r.window_days) < 1e-9 for r in out)
    return [(r.k, r.day, r.window_days, r.a_total, r.a_prior, r.b_total) for r in out]


def test_against_brute_force_with_gaps_and_long_windows(spark):
    data, windows = rows(1), [1, 7, 30, 64, 65, 150]
    got = answers(build_trees(daily(spark, data), "k", "d", ["a", "b"]), windows)
    assert len(got) == len(set(got)) and set(got) == brute(data, windows)


def test_late_corrections_equal_a_rebuild_and_touch_only_ancestors(spark):
    data = rows(2)
    late = [("u", date(2026, 1, 9), 5, 2, 1), ("u", date(2026, 1, 9), -1, 0, 1), ("new", date(2026, 3, 3), 4, None, 1), (None, date(2026, 1, 1), 9, 9, 9)]
    trees = build_trees(daily(spark, data), "k", "d", ["a", "b"])
    fixed = correct_trees(trees, spark.createDataFrame(late, SCHEMA), "k", "d", ["a", "b"])
    assert set(answers(fixed, [7, 30])) == brute(data + late, [7, 30])
    before = {(r.k, r.shard): r.a for r in trees.collect()}
    day = (date(2026, 1, 9) - date(1970, 1, 1)).days
    for r in fixed.where("k = 'u'").collect():
        changed = {i for i, (x, y) in enumerate(zip(before[(r.k, r.shard)], r.a)) if x != y}
        assert changed == ({(64 + day % 64) >> i for i in range(7)} if r.shard == day // 64 else set())


def test_empty(spark):
    trees = build_trees(daily(spark, []), "k", "d", ["a", "b"])
    assert answers(trees, [7]) == [] and correct_trees(trees, spark.createDataFrame([], SCHEMA), "k", "d", ["a", "b"]).count() == 0


def test_a_wrong_year_is_answered_in_pieces(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from sievemark.operators.rolling import build_trees, rolling_totals

    daily = spark.createDataFrame([("u", date(2026, 1, 1), 5), ("u", date(3026, 1, 1), 7), ("v", date(2026, 1, 1), 1)], "url string, day date, clicks long")
    r = rolling_totals(build_trees(daily, "url", "day", ["clicks"]), "url", ["clicks"], [7])
    got = r.groupBy("url").agg(F.count("*").alias("n"), F.sum("clicks_total").alias("s"), F.countDistinct("day").alias("d")).collect()
    n = (date(3026, 1, 1) - date(2026, 1, 1)).days + 1
    assert {(x.url, x.n, x.s, x.d) for x in got} == {("u", n, 7 * 5 + 7, n), ("v", 1, 1, 1)}
