"""Mapping freely typed values to a canonical list."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cyrillic and Greek letters that look like Latin ones, and digits used as letters.
_LOOKALIKE = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_LETTERS = {"ł": "l", "đ": "d", "ø": "o", "ı": "i", "æ": "a", "œ": "o", "ß": "s"}


def _fold_table() -> tuple[str, str]:
    """Lower-case Latin and full-width characters to plain ASCII, by their decomposition."""
    table = dict(_LETTERS) | _LOOKALIKE
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        low = chr(code).lower()
        plain = unicodedata.normalize("NFKD", low)[0]
        if len(low) == 1 and low not in table and plain != low and plain.isascii():
            table[low] = plain
    return "".join(table), "".join(table.values())


def fold(text: Column) -> Column:
    """Lower case without accents, invisible characters, look-alikes and percent escapes."""
    source, target = _fold_table()
    escaped = F.when(text.contains("%"), F.coalesce(F.try_url_decode(text), text)).otherwise(text)
    return F.translate(F.regexp_replace(F.lower(escaped), "[\\p{M}\\p{Cf}]", ""), source, target)


def _squash(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\p{L}\\p{N}]", "")


def whole_value(folded: Column) -> Column:
    """The value as its only candidate phrase."""
    return F.array(folded)


def agent_phrases(folded: Column) -> Column:
    """Phrases of a user agent that may be a name: the parts between brackets, semicolons,
    equals signs, quotes and version numbers, without addresses, and up to three words of a
    part in a row."""
    bare = F.regexp_replace(folded, "\\S*(?:https?://|mailto:)\\S*|\\s-\\s", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "\\s+[-–]\\s+", "-"), "[+]", " ")
    parts = F.split(bare, "[;:,()=\"']+|(?:/\\s*|\\s+)v?[0-9][0-9._]*(?![\\p{L}0-9])")
    words = F.transform(parts, lambda p: F.filter(F.split(p, "\\s+"), lambda w: w != ""))
    runs = F.flatten(F.transform(words, lambda ws: F.flatten(F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: k <= F.size(ws)), lambda k: F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.array_join(F.slice(ws, i, k), ""))))))
    return F.flatten(F.array(runs, F.transform(words, lambda ws: F.array_join(ws, ""))))


def _grams(name: Column) -> Column:
    """Bigrams and trigrams of ^name$, each once."""
    marked = F.concat(F.lit("^"), name, F.lit("$"))
    n = F.length(marked)
    take = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(marked, i, F.lit(k)))
    return F.array_distinct(F.concat(take(2), F.when(n >= 3, take(3)).otherwise(F.array().cast("array<string>"))))


def _weighed(grams: DataFrame, of: str, rest: Column, reach: float) -> DataFrame:
    """Adds ``_all``, the squared length of each name's vector, and ``_lead``: whether a gram is one of the
    rarest of its name, which any other name of at least that cosine must share.

    ``grams`` has ``of``, gram and its idf; ``rest`` is what unlisted grams add. A name's grams are taken rare first until
    those left over are too short a vector to reach the cosine by themselves.
    """
    w = Window.partitionBy(of)
    left = F.sum(F.pow("idf", F.lit(2))).over(w.orderBy(F.desc("idf"), "gram").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum(F.pow("idf", F.lit(2))).over(w) + rest
    return grams.withColumn("_all", total).withColumn("_lead", left >= F.col("_all") * (reach * reach) - 1e-9)


def match_values(values: DataFrame, column: str, reference: DataFrame, entry: str, phrases: Callable[[Column], Column] = whole_value, threshold: float = 0.45, margin: float = 0.08, edits: int = 3, shortest: int = 4) -> DataFrame:
    """One row per distinct non-null value: ``column, n_rows, phrase, entry, score, margin``.

    entry is null for values that name no entry of the list. Values are counted first, so
    a value that holds a third of all rows is handled once; then they are folded, cut
    into phrases (repeated phrases again only once) and squashed to letters and digits.
    Phrases not so short or long that more than ``edits`` edits would be needed for any
    entry meet the list in an inverted index of character bigrams and trigrams and are scored by cosine
    under inverse document frequency of the list. Both sides enter the index only with their
    rarest grams: those that any pair of a cosine of at least threshold - margin must share, so no
    such pair is lost and grams that many names have build no long lists.

    A phrase is accepted when it equals an entry, however short and with or without letters. Otherwise it
    needs ``shortest`` characters, a letter, a best score of at least ``threshold``, a lead of
    ``margin`` over the second entry (entries under threshold - margin aren't looked at, so the
    lead given is the least that it can be), and at most ``edits`` edits (one for entries under 6 characters, two under
    10). Digits are also tried as letters. A value takes its best phrase; equal scores go to the first entry by name.

    The list may have repeated, null or blank entries. Empty values, values without letters
    and very long values are just unmatched or matched like any other. Nothing is broadcast
    by hint: the index is joined by size.
    """
    reach = max(threshold - margin, 0.0)
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    split = counted.select(column, "n_rows", F.array_distinct(phrases(fold(F.col(column)))).alias("_p"))
    names = F.transform("_p", _squash)
    both = F.array_distinct(F.concat(names, F.transform(names, lambda x: F.translate(x, "".join(_DIGITS), "".join(_DIGITS.values())))))
    refs = reference.where(F.col(entry).isNotNull()).select(F.col(entry).alias("entry"), _squash(fold(F.col(entry))).alias("_name")).where("_name <> ''").dropDuplicates(["entry"])
    postings = refs.select("entry", F.explode(_grams(F.col("_name"))).alias("gram"))
    n, least, most = refs.agg(F.count(F.lit(1)), F.coalesce(F.min(F.length("_name")), F.lit(0)), F.coalesce(F.max(F.length("_name")), F.lit(0))).first()
    exploded = split.select(column, F.explode(F.filter(both, lambda x: F.length(x).between(max(1, least - edits), most + edits))).alias("phrase"))
    idf = postings.groupBy("gram").agg(F.log(1 + F.lit(float(n)) / F.count(F.lit(1))).alias("idf"))
    listed = _weighed(postings.join(idf, "gram"), "entry", F.lit(0.0), reach)
    # what an entry adds to the dot product by each gram, at most twice its name's length
    entries = listed.groupBy("entry").agg(F.map_from_entries(F.collect_list(F.struct("gram", F.pow("idf", F.lit(2)) / F.sqrt("_all")))).alias("_adds")).join(refs, "entry")

    top = math.log(1 + n)  # grams outside the list weigh as much as the rarest gram of it
    distinct = exploded.select("phrase").distinct()
    grams = distinct.select("phrase", F.size(_grams(F.col("phrase"))).alias("_m"), F.explode(_grams(F.col("phrase"))).alias("gram")).join(idf, "gram")
    known = _weighed(grams, "phrase", (F.col("_m") - F.count(F.lit(1)).over(Window.partitionBy("phrase"))) * F.lit(top * top), reach)
    pairs = known.where("_lead").select("phrase", "gram").join(listed.where("_lead").select("entry", "gram"), "gram").select("phrase", "entry").distinct()
    asked = known.groupBy("phrase").agg(F.collect_list("gram").alias("_g"), F.sqrt(F.first("_all")).alias("_length"))
    dot = F.aggregate(F.transform("_g", lambda g: F.coalesce(F.col("_adds")[g], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(asked, "phrase").join(entries, "entry").select("phrase", "entry", "_name", F.round(dot / F.col("_length"), 12).alias("score"))
    place = F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("score"), "entry"))
    two = scored.withColumn("_k", place).where("_k <= 2")
    ranked = two.groupBy("phrase").agg(F.max(F.when(F.col("_k") == 1, F.struct("score", "entry", "_name"))).alias("b"), F.max(F.when(F.col("_k") == 2, F.col("score"))).alias("_2"))
    close = F.least(F.lit(edits), F.when(F.length("b._name") < 6, 1).when(F.length("b._name") < 10, 2).otherwise(3))
    lead = F.col("b.score") - F.greatest(F.coalesce("_2", F.lit(reach)), F.lit(reach))
    exact = F.col("phrase") == F.col("b._name")
    alike = (F.length("phrase") >= shortest) & F.col("phrase").rlike("\\p{L}") & (F.col("b.score") >= threshold) & (lead >= margin - 1e-9) & F.levenshtein("phrase", "b._name", edits + 1).between(0, close)
    accepted = ranked.where(exact | alike).select("phrase", F.col("b.entry").alias("entry"), F.col("b.score").alias("score"), lead.alias("margin"))
    best = exploded.join(accepted, "phrase").groupBy(column).agg(F.min(F.struct((-F.col("score")).alias("_s"), "entry", "phrase", "score", "margin")).alias("m"))
    return counted.join(best, column, "left").select(column, "n_rows", "m.phrase", "m.entry", "m.score", "m.margin")


def map_rows(rows: DataFrame, column: str, matched: DataFrame) -> DataFrame:
    """The rows whose value was matched, with ``entry``. Equal values share one lookup; a hot
    value is one skewed key, which adaptive execution splits. An own column ``entry`` of the rows is replaced."""
    return rows.drop("entry").join(matched.where("entry IS NOT NULL").select(column, "entry"), column)
