import random
from collections import Counter

import numpy as np

from sievemark.llm.encoding import PairModel, improbable_runs, inverses, maximal_segments, pair_counts, repair_encoding

CLEAN = ["Der Prüfer hört früh über schöne Städte und Brücken", "L’élève répète la règle près de la forêt", "El año próximo añadirá más información aquí", "Não há opções; a descrição está à espera", "Żółta gęś powtarza się na każdej stronie", "It’s “free” — that’s all we can’t measure", "Ελέγξτε τον τίτλο της σελίδας", "見出しと要約を確認する。", "SÃO, MAÇÃ, ÂMBITO, ATENÇÃO", "Ondelu® © 2026, 5 °C, ½ page, &eacute; and &uuml; in HTML"]


def damage(t, written, read):
    return t.encode(written, "replace").decode(read, "replace")


def corpus():
    r = random.Random(4)
    texts = [" ".join(r.choice(CLEAN) for _ in range(3)) for _ in range(1200)]
    want = {}
    for i in range(0, 1200, 24):
        kind = (i // 24) % 4
        clean = r.choice(CLEAN[:4]) if kind else r.choice(CLEAN[:6])
        bad = [lambda t: t.encode().decode("latin-1"), lambda t: t.encode().decode("mac_roman"), lambda t: damage(t, "cp1252", "mac_roman"), lambda t: t.encode().decode("latin-1").encode().decode("latin-1")][kind](clean)
        want[i], texts[i] = f"{texts[i]} {clean}", f"{texts[i]} {bad}"
    return texts, want


def test_damaged_texts_are_found_and_restored(spark):
    texts, want = corpus()
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], "doc_id long, text string, way string, n int")
    got = {r.doc_id: r.text for r in repair_encoding(df).collect()}
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def test_lost_null_empty_and_long(spark):
    texts = [None, "", " ", "plain", "caf� now", "plain " * 50_000, "“quoted” naïve café"]
    rows = repair_encoding(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.way, r.n_lost, r.text) for r in rows] == [(4, "lost", 1, "caf� now")]
    assert repair_encoding(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 3], "text string")
    one, many = pair_counts(df.coalesce(1), "text"), pair_counts(df.repartition(5), "text")
    assert np.array_equal(one, many) and one[-1] == 3 * sum(map(len, CLEAN))


def test_round_trips_and_segments():
    for t in CLEAN[:6]:
        for read in ("latin_1", "mac_roman", "koi8_r", "cp866"):
            assert t in {r for _, r in inverses(t.encode().decode(read))}
    assert maximal_segments([-1, 2, -1, 3, -9, 4]) == [(1, 4), (5, 6)] and maximal_segments([-1, -2]) == [] and maximal_segments([]) == []
    # the published example of the algorithm
    assert maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1), (2, 3), (4, 11)]


def test_runs_are_found_in_the_whole_text(spark):
    texts = [" ".join(CLEAN[:6]) for _ in range(50)] + ["Der Prüfer hÃ¶rt und schÃ¶n, doch früh"]
    model = PairModel(pair_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text"))
    assert [texts[-1][a:z] for a, z in improbable_runs(model, [texts[-1]], 3.5)[0]] == ["Ã¶", "Ã¶"]
    many = ["plain text", texts[-1], "", texts[0], texts[-1], *CLEAN]
    assert improbable_runs(model, many, 3.5) == [improbable_runs(model, [t], 3.5)[0] for t in many] and improbable_runs(model, [""], 3.5) == [[]]


def test_a_single_damaged_symbol_that_no_text_holds(spark):
    texts = [" ".join(random.Random(i).choice(CLEAN) for _ in range(3)) for i in range(300)]
    symbols = {3: ("😀", "cp1252"), 40: ("日", "latin_1"), 77: ("☃", "latin_1"), 110: ("🎉🚀⚙", "cp1252"), 150: ("✓", "mac_roman")}
    want = {i: f"{texts[i]} done {x} here" for i, (x, _) in symbols.items()}
    rows = [f"{t} done {symbols[i][0].encode().decode(symbols[i][1]) if i in symbols else 'well'} here" for i, t in enumerate(texts)]
    rows += ["il a dit « passé…» à « demain »", "в Азії рак і ёлка, ЁРШИ", "l’été…», c’est l’é"]
    got = {r.doc_id: r.text for r in repair_encoding(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == want


def test_pairs_are_counted_exactly_however_many(spark):
    r = random.Random(9)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(1000)) for _ in range(700)]
    rare = [(0x4E00 + i, 0xAC00 + i) for i in range(300)]
    texts += [chr(b) + " " + chr(a) for a, b in rare for _ in range(9)]
    model = PairModel(pair_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text"))
    want = Counter(p for t in texts for p in zip(map(ord, t), map(ord, t[1:])))
    assert len(want) > 600_000 and all(model.count(a, b) == 0 for a, b in rare)
    assert all(model.count(*p) == want[p] for p in r.sample(sorted(want), 3000))
