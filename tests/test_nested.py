import json
import random

from sievemark.operators.nested import flatten_nested

STRUCT = "array<struct<q:string,n:long,f:array<string>,o:struct<x:string,l:array<string>>>>"
SCHEMA = f"id long, a {STRUCT}, b {STRUCT}, branch string, position int"
NASTY = ['plain', 'say "hi"', "back\\slash", 'end\\"', "[{,:}]", "", "null", "é\n\t💡", "\\\\", None]


def run(spark, rows, step=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = flatten_nested(df, "id", ["a", "b"], {"a": ["f"], "b": ["f", "missing"]}, step=step).collect()
    slim = flatten_nested(df, "id", ["a", "b"], {"a": ["f"], "b": ["f"]}, fields=False).collect()
    assert {(r.id, r.branch, r.position, r.sub_position) for r in out} == {(r.id, r.branch, r.position, r.sub_position) for r in slim}
    assert len(out) == len(slim)
    return sorted((r.id, r.branch, r.position, r.sub_position, r.value, tuple(sorted(((k, v) for k, v in (r.fields or {}).items() if k != "o")))) for r in out)


def brute(rows):
    out = []
    for i, a, b in rows:
        if i is None:
            continue
        for name, items in (("a", a), ("b", b)):
            for p, x in enumerate(items or []):
                if x is None:
                    continue
                out.append((i, name, p, -1, None, tuple(sorted((k, str(v)) for k, v in zip("qn", x[:2]) if v is not None))))
                out += [(i, f"{name}.f", p, j, v, ()) for j, v in enumerate(x[2] or []) if v is not None]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(5)
    item = lambda: r.choice([None, (r.choice(NASTY), r.choice([None, -3, 10**12]), r.choice([None, [], [r.choice(NASTY) for _ in range(r.randrange(4))]]), r.choice([None, (r.choice(NASTY), ["f", "f"])]))])
    rows = [(r.choice([None, *range(5)]) if i == 0 else i, r.choice([None, [], [item() for _ in range(r.randrange(9))]]), r.choice([None, [item()]])) for i in range(80)]
    assert run(spark, rows) == brute(rows)


def test_very_long_arrays_and_texts(spark):
    rows = [(1, [("x" * 200_000, 1, ["y" * 100_000], None)], [(str(i), i, [], None) for i in range(5000)])]
    assert run(spark, rows, step=64) == brute(rows)
    assert json.dumps("x")


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, [])]) == []
