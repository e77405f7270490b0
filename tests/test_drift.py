import json
from datetime import datetime, timedelta

from sievemark.operators.drift import schema_changes, union_table

SCHEMA = "feed string, file_id long, exported_at timestamp, line_no int, body string, field string, query string"
T0 = datetime(2026, 1, 1)


def lines(spark, files):
    rows = [(feed, f, T0 + timedelta(day), i, b if isinstance(b, str) or b is None else json.dumps(b), "own", "own") for feed, f, day, bodies in files for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted((r.file_id, r.field, r.new_field, r.change) for r in schema_changes(lines(spark, files)).collect())


def test_all_kinds_of_change(spark):
    q = [f"q{i}" for i in range(6)]
    first = [{"query": x, "volume": 1000 + i, "cpc": 1.5, "old": "z", "tags": ["a", "b"], "score": {"v": i}} for i, x in enumerate(q)]
    second = [{"query": x, "search_volume": f"{1000 + i:,}" if i else "7", "cpc": "1.5", "fresh": 1, "labels": "a|b", "score": i, "n": None} for i, x in enumerate(q)]
    got = changes(spark, [("f", 2, 5, [*second, "﻿" + json.dumps(second[0]), '{"query": "cut', None, "[1]", ""]), ("f", 1, 1, [*first, *first]), ("f", 3, 7, ["broken"]), ("f", 4, 9, second), ("g", 5, 2, first)])
    assert got == [(2, "cpc", "", "retyped"), (2, "fresh", "", "added"), (2, "labels", "", "retyped"), (2, "old", "", "removed"), (2, "score", "", "retyped"), (2, "search_volume", "", "retyped"), (2, "tags", "labels", "renamed"), (2, "volume", "search_volume", "renamed")]


def test_same_values_on_few_queries_is_no_rename(spark):
    a, b = [{"query": str(i), "x": i} for i in range(4)], [{"query": str(i), "y": i if i < 2 else 90 + i} for i in range(4)]
    assert changes(spark, [("f", 1, 1, a), ("f", 2, 2, b)]) == [(2, "x", "", "removed"), (2, "y", "", "added")]


def test_union_table_promotes_and_keeps_all_lines(spark):
    v = lines(spark, [("f", 1, 1, [{"query": "a", "n": 1, "s": 1}, {"query": None, "n": 2}]), ("f", 2, 2, [{"query": "a", "n": 2.5, "s": "x"}])])
    t = union_table(v)
    assert dict(t.dtypes)["n"] == "decimal(20,1)" and dict(t.dtypes)["s"] == "string"
    assert sorted((r.file_id, r.line_no, r.n, r.s) for r in t.collect()) == [(1, 0, 1, "1"), (1, 1, 2, None), (2, 0, 2.5, "x")]


def test_union_table_keeps_digits_and_takes_the_last_delivery(spark):
    from decimal import Decimal

    odd = 'It\'s "it"'
    wide = '{"big": 99999999999999999999, "d": 0.123456789012345678901, "N": 1, "n": 2, "feed": "own", "e": 1e30, ' + json.dumps(odd) + ": 1}"
    rows = [("f", 1, T0, 0, wide, T0), ("f", 1, T0, 0, '{"big": 5}', T0 - timedelta(1)), ("f", 1, T0, None, '{"big": 6}', T0), ("f", 1, T0, None, '{"big": 7}', T0), ("f", 1, T0, None, '{"big": 7}', None)]
    t = union_table(spark.createDataFrame(rows, "feed string, file_id long, exported_at timestamp, line_no int, body string, delivered_at timestamp"))
    got = sorted(((r["big"], r["d"], r["N"], r["n_2"], r["field_feed"], r["e"], r[odd]) for r in t.collect()), key=lambda x: x[0])
    assert got == [(6, *[None] * 6), (7, *[None] * 6), (99999999999999999999, Decimal("0.123456789012345678901"), 1, 2, "own", 1e30, 1)]


def test_empty(spark):
    assert changes(spark, []) == [] and union_table(lines(spark, [])).count() == 0


def test_against_brute_force_on_a_table(spark):
    import os

    path = "/root/testdata/sf0.01/keyword_exports.parquet"
    if not os.path.exists(path):
        return
    df = spark.read.parquet(path)
    files, order = {}, {}
    for r in df.collect():
        try:
            o = json.loads((r.body or "").lstrip("﻿"))
        except ValueError:
            continue
        files.setdefault(r.file_id, {})[r.line_no] = o
        order.setdefault(r.feed, set()).add((r.exported_at, r.file_id))
    kind = lambda v: {int: "integer", float: "decimal", str: "string", list: "array", dict: "object"}[type(v)]

    def plain(v):
        if isinstance(v, dict):
            v = next(iter(v.values()))
        if isinstance(v, list):
            return "|".join(v)
        try:
            return float(str(v).replace(",", ""))
        except ValueError:
            return v

    want = set()
    for group in order.values():
        ids = [f for _, f in sorted(group)]
        for a, b in zip(ids, ids[1:]):
            old, new = ({k: kind(v) for o in files[f].values() for k, v in o.items() if v is not None} for f in (a, b))
            qa, qb = ({o["query"]: o for o in files[f].values() if o.get("query")} for f in (a, b))
            done = set()
            for g in sorted(set(old) - set(new)):
                for c in sorted(set(new) - set(old)):
                    both = [(plain(qa[q][g]), plain(qb[q][c])) for q in qa.keys() & qb.keys() if qa[q].get(g) is not None and qb[q].get(c) is not None]
                    if both and sum(x == y for x, y in both) * 2 > len(both):
                        want.add((b, g, c, "renamed"))
                        done |= {g, c}
                        if old[g] != new[c]:
                            want.add((b, c, "", "retyped"))
            want |= {(b, f, "", "added") for f in set(new) - set(old) - done} | {(b, f, "", "removed") for f in set(old) - set(new) - done}
            want |= {(b, f, "", "retyped") for f in set(new) & set(old) if new[f] != old[f]}
    assert {(r.file_id, r.field, r.new_field, r.change) for r in schema_changes(df).collect()} == want
