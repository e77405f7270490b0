"""Token, sentence and share functions as JVM-side column expressions.

Lower case is ASCII-only and token lengths are bytes, so a lone accented letter is a token
of two bytes and capitals beyond ASCII stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Word and phrase lists that decide results.
FUNCTION_WORDS = [
    "the", "a", "an", "of", "to", "in", "for", "on", "with", "at", "by", "from", "as", "is", "are",
    "was", "were", "be", "been", "this", "that", "it", "and", "or", "but", "we", "you", "our",
    "your", "their",
]
FILLER_PHRASES = [
    "in order to", "it is important", "when it comes to", "in today's", "a wide range of", "comprehensive",
    "cutting-edge", "leverage", "best-in-class", "world-class", "at the end of the day",
]
FACT_WORDS = ["licensed", "license", "insured", "certified", "warranty", "permit", "bonded", "price", "same-day", "haifa", "vancouver"]
INTENT_STOP_WORDS = ["in", "the", "a", "an", "and", "or", "for", "of", "to", "on", "at", "wa", "il"]
INTENTS = {
    "local service": ["price", "how long", "warranty", "same-day", "service area", "licensed", "insured", "permit"],
    "contractor verification": ["license", "bonded", "insurance", "reviews", "years of experience"],
}
ANSWER_CUES = [" because ", " costs ", " takes ", " located ", " licensed "]


def ascii_lower(t: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(t, UPPER, LOWER)


def tokens(t: Column) -> Column:
    """Runs of letters and digits of at least two bytes, ASCII-lowered. Null gives null."""
    return F.filter(F.split(ascii_lower(t), "[^\\p{L}\\p{N}]+"), lambda x: F.octet_length(x) >= 2)


def words(t: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(t, "[\\s\\u00a0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u0085\\u1680]+"), lambda x: x != "")


def sentences(t: Column) -> Column:
    """Pieces up to . ! or ? (and the tail) that hold at least three words, trimmed."""
    parts = F.regexp_extract_all(t, F.lit("[^.!?]*[.!?]|[^.!?]+$"), F.lit(0))
    return F.filter(F.transform(parts, collapse_ends), lambda s: F.size(words(s)) >= 3)


def collapse_ends(t: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")


def collapse(t: Column) -> Column:
    """White space runs to single blanks, none at the ends."""
    return F.array_join(words(t), " ")


def compact(t: Column) -> Column:
    """Lower case without any white space, for phrase matches across line breaks."""
    return F.lower(F.regexp_replace(t, "(?U)\\s", ""))


def shingles(toks: Column, width: int) -> Column:
    """Distinct runs of ``width`` tokens; fewer tokens than that stand for themselves.

    Shifted copies of the array are zipped: a lambda that sliced the array would evaluate
    it anew for every shingle.
    """
    n = F.size(toks) - (width - 1)
    zipped = F.arrays_zip(*[F.slice(toks, k + 1, F.greatest(n, F.lit(0))).alias(f"t{k}") for k in range(width)])
    runs = F.transform(zipped, lambda z: F.concat_ws(" ", *[z[f"t{k}"] for k in range(width)]))
    return F.array_distinct(F.when(n < 1, toks).otherwise(runs))


def share(part: Column, whole: Column) -> Column:
    """Floor percent, at most 100; null where the whole is 0."""
    return F.when(whole != 0, F.least(F.floor(part * 100 / F.nullif(whole, F.lit(0))).cast("int"), F.lit(100)))


def is_fact(token: Column) -> Column:
    """Holds a digit or is one of the fact words."""
    return token.rlike("[0-9]") | token.isin(FACT_WORDS)


def is_specific(token: Column, bytes_over: int) -> Column:
    """Longer than so many bytes, or holds a digit."""
    return (F.octet_length(token) > bytes_over) | token.rlike("[0-9]")


def count_where(items: Column, test) -> Column:
    """Number of array items that pass a test."""
    return F.size(F.filter(items, test))


def filler_hits(t: Column) -> Column:
    """Filler phrases that a text contains."""
    # the lowered text is bound once, not written out per phrase
    return F.transform(F.array(ascii_lower(t)), lambda low: sum((F.when(low.contains(p), 1).otherwise(0) for p in FILLER_PHRASES), F.lit(0)))[0]


def answer_cue(t: Column) -> Column:
    """Whether a text asks or answers by a fixed phrase."""
    def cued(low: Column) -> Column:
        hit = low.contains("?")
        for c in ANSWER_CUES:
            hit = hit | low.contains(c)
        return hit

    return F.transform(F.array(ascii_lower(t)), cued)[0]


def contains_token(t: Column, needle: str) -> Column:
    """An ASCII needle between characters that are neither ASCII letters nor digits, whatever the case; any
    other needle anywhere. The pattern is only tried on texts that contain the needle."""
    import re

    if not needle.isascii():
        return t.contains(needle)
    return ascii_lower(t).contains(needle.lower()) & t.rlike("(?i)(?<![A-Za-z0-9])" + re.escape(needle) + "(?![A-Za-z0-9])")


def contains_hebrew(t: Column) -> Column:
    """Any character of the Hebrew block."""
    return t.rlike("[\\u0590-\\u05FF]")


def intent_tokens(t: Column) -> Column:
    """ASCII-lowered words of more than two bytes that aren't stop words."""
    return F.filter(F.transform(words(t), ascii_lower), lambda x: (F.octet_length(x) > 2) & ~x.isin(INTENT_STOP_WORDS))


def band(v: Column) -> Column:
    """low, medium or high by thirds; unmeasured for null."""
    return F.when(v.isNull(), "unmeasured").when(v <= 33, "low").when(v <= 66, "medium").otherwise("high")
