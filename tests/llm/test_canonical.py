from pyspark.sql import functions as F

from sievemark.llm.canonical import agent_phrases, map_rows, match_values, whole_value

AGENTS = ["mirlobot", "mirlo-searchbot", "quorrax", "ondrucrawler", "sylvet-user", None, "", "mirlobot"]
NAMED = {
    "mirlobot": "mirlobot", "Mozilla/5.0 (compatible; Mirlo_Bot/2.1; +https://x.example/mirlo)": "mirlobot", "MIRLO%2DSearchBot/1.0": "mirlo-searchbot", "  m1rl0b0t ": "mirlobot", "ＱＵＯＲＲＡＸ/3": "quorrax",
    "quоrrах": "quorrax", "qu­orrax v2.0": "quorrax", "qourrax": "quorrax", "Odruu_Crawler/1.9": "ondrucrawler", "crawl-agent=Sylvet+User;v=3": "sylvet-user", "agent: sÿlvet - user": "sylvet-user",
    "Mozilla/5.0 (Linux) AppleCore/584.1 (like Veloura) Ondru Crawler/3.2": "ondrucrawler", "word " * 20_000 + "; quorrax/1": "quorrax",
}
OTHERS = ["axlebot", "bot", "", "-", "Mozilla/5.0 (X11; Linux x86_64)", "moorlight-user/4.4", "100%", "crawler", "٣٤"]


def match(spark, values, agents=AGENTS, phrases=agent_phrases):
    v = spark.createDataFrame([(x, "own", 1) for x in values], "ua string, entry string, n_rows int")
    return v, match_values(v, "ua", spark.createDataFrame([(a,) for a in agents], "token string"), "token", phrases)


def test_spellings_and_strangers(spark):
    _, m = match(spark, [*NAMED, *OTHERS, *OTHERS, None])
    got = {r.ua: (r.entry, r.n_rows) for r in m.collect()}
    assert {k: got[k][0] for k in NAMED} == NAMED
    assert all(got[k] == (None, 2) for k in OTHERS) and None not in got


def test_rows_keep_repeats_and_replace_entry(spark):
    v, m = match(spark, ["mirlobot", "mirlobot", "bot", None])
    assert [tuple(r) for r in map_rows(v, "ua", m).select("ua", "entry").collect()] == [("mirlobot", "mirlobot")] * 2


def test_plain_values_and_ties(spark):
    _, m = match(spark, ["Münster", "munster", "Muenchen"], ["Munster", "MUNSTER", "München"], whole_value)
    got = {r.ua: r.entry for r in m.collect()}
    assert got["Münster"] is None or got["Münster"].upper() == "MUNSTER"
    assert got["Münster"] == got["munster"]


def test_short_and_numeric_entries_match_as_they_are(spark):
    values = ["BMW", "bmw", "Ulm", "2024", "20 24", "b.m.w.", "Audi ", "ulmo", "bnw", "2025", "Volkswagn"]
    _, m = match(spark, values, ["BMW", "Audi", "Ulm", "Volkswagen", "2024"], whole_value)
    assert {r.ua: r.entry for r in m.collect()} == dict(zip(values, ["BMW", "BMW", "Ulm", "2024", "2024", "BMW", "Audi", "Ulm", None, None, "Volkswagen"]))


def test_rare_grams_lose_no_match(spark):
    import math
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(5, 9)))
    listed = sorted({word() for _ in range(120)})
    values = sorted({w[:i] + r.choice("abcde") + w[i + 1 :] for w in listed for i in (1, 3)} | {word() for _ in range(200)})
    grams = lambda x: {f"^{x}$"[i : i + k] for k in (2, 3) for i in range(len(x) + 3 - k)}
    df: dict[str, int] = {}
    for w in listed:
        for g in grams(w):
            df[g] = df.get(g, 0) + 1
    top = math.log(1 + len(listed))
    idf = lambda g: math.log(1 + len(listed) / df[g]) if g in df else top
    length = lambda x: math.sqrt(sum(idf(g) ** 2 for g in grams(x)))
    want = {v: max((round(sum(idf(g) ** 2 for g in grams(v) & grams(e)) / length(v) / length(e), 9), e) for e in listed) for v in values}
    got = {x.ua: x for x in match(spark, values, listed, whole_value)[1].collect()}
    assert sum(x.entry is not None for x in got.values()) > 50
    assert all(abs(x.score - want[v][0]) < 1e-6 for v, x in got.items() if x.entry is not None)
    near = {v for v, (c, e) in want.items() if c >= 0.4 and v not in listed}
    assert {v for v, x in got.items() if x.entry is not None and v not in listed} <= near


def test_empty(spark):
    assert match(spark, [])[1].count() == 0
    assert [r.entry for r in match(spark, ["mirlobot"], [])[1].collect()] == [None]
    assert F is not None
