"""Content intelligence over texts: profiles, sentences, chunks, intents, duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (
    FILLER_PHRASES, FUNCTION_WORDS, INTENTS, answer_cue, ascii_lower, band, collapse, collapse_ends, count_where, filler_hits, is_fact, is_specific, sentences, share, tokens, words,
)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_text"))


def token_profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Floor-percent shares per text: repetition, entity, numeric, fact, function, specific, filler.

    Texts without tokens have null shares; null texts are left out. One pass, no shuffle.
    """
    t = _texts(docs, key, text).withColumn("_t", tokens(F.col("_text"))).withColumn("_n", F.size("_t"))
    n = F.col("_n")
    unique = F.size(F.array_distinct("_t"))
    titled = count_where(words(F.col("_text")), lambda w: w.rlike("^\\p{Lu}"))
    of = lambda part: F.when(n > 0, share(part, n))
    s = t.select(
        key, n.alias("n_tokens"), unique.alias("n_unique"), of(n - unique).alias("repetition"), of(titled).alias("entity_density"), of(count_where("_t", lambda x: x.rlike("[0-9]"))).alias("numeric_density"),
        of(count_where("_t", is_fact)).alias("fact_density"), of(count_where("_t", lambda x: x.isin(FUNCTION_WORDS))).alias("function_word_ratio"), of(count_where("_t", lambda x: is_specific(x, 8))).alias("specificity"),
        F.when(F.col("_text") != "", F.floor(filler_hits(F.col("_text")) * 100 / len(FILLER_PHRASES)).cast("int")).alias("filler_phrase_ratio"),
        F.try_element_at(F.filter("_t", lambda x: F.octet_length(x) > 5), F.lit(1)).alias("witness"),
    )
    return s.withColumns({"genericity_band": band(F.col("function_word_ratio")), "specificity_band": band(F.col("specificity"))})


def sentence_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences, floor mean length, share over 30 words and variance band per text."""
    t = _texts(docs, key, text).select(key, F.transform(sentences(F.col("_text")), lambda s: F.size(words(s))).alias("_l"))
    n = F.size("_l")
    total = F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x * x)
    # exact whole-number comparison of n * sum of squares - square of the sum against the bands
    spread = n * squares - total * total
    level = F.when(n < 2, "unmeasured").when(spread < 8 * n * n, "low").when(spread < 40 * n * n, "medium").otherwise("high")
    return t.select(key, n.alias("n_sentences"), F.floor(total / F.nullif(n, F.lit(0))).cast("int").alias("avg_sentence_length"), F.when(n > 0, share(count_where("_l", lambda x: x > 30), n)).alias("long_sentence_share"), level.alias("sentence_variance"))


def _measured(codes: np.ndarray, width: int) -> tuple[int, int, int | None]:
    """Entropy, moving type-token share and lexical diversity of one text's tokens as numbers."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    last = np.full(n, -1)
    again = np.flatnonzero(codes[order][1:] == codes[order][:-1])
    last[order[again + 1]] = order[again]  # where the same token stood before
    counts = np.bincount(codes)
    p = counts[counts > 0] / n
    entropy = 0 if len(p) == 1 else int(min(max(-(p * np.log2(p)).sum() / math.log2(len(p)) * 100, 0.0), 100.0) + 0.5)
    if n < width:
        mattr = len(p) * 100 // n
    else:
        # a token is new to each window that begins after its last occurrence and reaches it
        at = np.arange(n)
        mattr = int(np.maximum(np.minimum(at, n - width) - np.maximum(np.maximum(last + 1, at - (width - 1)), 0) + 1, 0).sum()) * 100 // ((n - width + 1) * width)
    if n < 20:
        return entropy, mattr, None
    factors, run, began = 0, 0, 0
    new = 0
    for i, before in enumerate(last.tolist()):
        run += 1
        new += before < began
        if run >= 10 and new * 100 // run < 72:
            factors, run, new, began = factors + 1, 0, 0, i + 1
    return entropy, mattr, 100 if not factors else min(n * 100 // (factors * 10), 100)


def lexical_measures(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """``key, term_entropy, mattr, mtld`` of every text with tokens, without a shuffle.

    term_entropy is normalised, in percent (0 for one distinct token); mattr the mean share of distinct
    tokens in every window of ``width``, of the whole text if it is shorter; mtld counts how
    often the share of distinct tokens falls under 72 % in runs of at least ten, null under 20 tokens.
    """
    t = _texts(docs, key, text).select(key, tokens(F.col("_text")).alias("_t")).where(F.size("_t") > 0)
    schema = T.StructType([docs.schema[key], *[T.StructField(c, T.IntegerType()) for c in ("term_entropy", "mattr", "mtld")]])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            codes = np.asarray(lists.flatten().dictionary_encode().indices)
            ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
            rows = [_measured(np.unique(codes[z - k : z], return_inverse=True)[1], width) for z, k in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), pa.int32()) for c in zip(*rows)]], names=schema.names) if rows else pa.RecordBatch.from_pylist([], pa.schema([pa.field(key, b.column(0).type), *[pa.field(c, pa.int32()) for c in schema.names[1:]]]))

    return t.mapInArrow(measure, schema)


def text_profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All measures of a text in one row, with the levels of redundancy and cohesion."""
    p = token_profile(docs, key, text).join(sentence_stats(docs, key, text), key).join(lexical_measures(docs, key, text), key, "left")
    rep, n = F.coalesce("repetition", F.lit(0)), F.col("n_sentences")
    redundancy = F.when((n < 2) & F.col("repetition").isNull(), "unmeasured").when(rep <= 20, "low").when(rep <= 45, "medium").otherwise("high")
    cohesion = F.when(F.col("term_entropy").isNull() & F.col("repetition").isNull(), "unmeasured").when(F.col("term_entropy") >= 70, "high").when((F.col("term_entropy") >= 45) & (F.col("repetition") <= 40), "medium").otherwise("low")
    return p.withColumns({"redundancy": redundancy, "cohesion": cohesion, "authorship": F.lit("UNMEASURED")})


def slice_between(text: Column, start: Column, following: Column) -> Column:
    """The part of a text from the first word of a heading to the first word of the next one, ASCII case ignored."""
    low, first = ascii_lower(text), lambda t: ascii_lower(F.try_element_at(words(t), F.lit(1)))
    begin = F.greatest(F.coalesce(F.instr(low, F.nullif(first(start), F.lit(""))), F.lit(0)), F.lit(1))
    rest = F.substr(low, begin)
    cut = F.coalesce(F.instr(rest, F.nullif(first(following), F.lit(""))), F.lit(0))
    return collapse_ends(F.when(cut > 0, F.substr(text, begin, cut - 1)).otherwise(F.substr(text, begin)))


def page_chunks(pages: DataFrame, key: str = "url", keep: tuple[str, ...] = ("heading",)) -> DataFrame:
    """Scored chunks ``key, chunk_no`` (and what is to be kept of heading and body) of pages with ``title, headings, text``.

    Two or more headings cut the text at each heading's first word; otherwise its sentences go
    by threes; a text without a sentence is one chunk under its title. Blank pages have none. The
    next heading is looked up in the page's own array, so nothing is shuffled.
    """
    heads = F.transform("headings", lambda h: h["text"])
    visible = collapse(F.concat_ws(" ", F.array_join(heads, " "), F.col("text")))
    p = pages.select(key, "title", F.col("text").alias("_text"), heads.alias("_h"), visible.alias("_v")).where(F.trim("_v") != "").withColumn("_s", sentences(F.col("_v")))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(upto(F.size("_h")), lambda i: F.struct(F.col("_h")[i].alias("heading"), slice_between(F.coalesce("_text", F.lit("")), F.col("_h")[i], F.coalesce(F.try_element_at("_h", i + 2), F.lit(""))).alias("body")))
    threes = F.transform(upto(F.ceil(F.size("_s") / 3).cast("int")), lambda i: F.struct(F.element_at("_s", i * 3 + 1).alias("heading"), F.array_join(F.slice("_s", i * 3 + 1, F.lit(3)), " ").alias("body")))
    whole = F.array(F.struct(F.coalesce("title", F.lit("page")).alias("heading"), F.coalesce("_text", F.lit("")).alias("body")))
    each = p.select(key, F.posexplode(F.when(F.size("_h") >= 2, cut).when(F.size("_s") > 0, threes).otherwise(whole)).alias("chunk_no", "_c")).select(key, "chunk_no", "_c.heading", "_c.body")
    return score_chunks(each, keep)


def intent_totals(docs: DataFrame, scope: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Answered phrases of each intent over all texts of a scope (a constant for a whole site)."""
    per = intent_hits(docs, key, text).join(docs.select(key, scope.alias("scope")), key)
    g = per.groupBy("scope", "intent", "questions").agg(F.bit_or("mask").alias("mask"))
    return g.select("scope", "intent", F.bit_count("mask").alias("answered"), "questions", F.concat_ws("/", F.bit_count("mask").cast("string"), F.col("questions").cast("string")).alias("coverage"))


def sentence_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of three sentences with their scores; a text without a sentence is one chunk. ``keep``: heading and body, if wanted."""
    t = _texts(docs, key, text).where(F.trim("_text") != "").withColumn("_s", sentences(F.col("_text")))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / 3).cast("int")), lambda i: F.struct(F.element_at("_s", i * 3 + 1).alias("heading"), F.array_join(F.slice("_s", i * 3 + 1, F.lit(3)), " ").alias("body")))
    whole = F.array(F.struct(F.lit("page").alias("heading"), F.col("_text").alias("body")))
    each = t.select(key, F.posexplode(F.when(F.size("_s") > 0, groups).otherwise(whole)).alias("chunk_no", "_c")).select(key, "chunk_no", "_c.heading", "_c.body")
    return score_chunks(each, keep)


def score_chunks(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds scores to rows with ``heading`` and ``body``; both give way to them unless kept."""
    c = chunks.withColumn("_t", tokens(F.col("body"))).withColumn("_n", F.size("_t"))
    n = F.col("_n")
    contained = F.when((F.size(words(F.col("heading"))) >= 2) & (n >= 8), 80).when(n >= 4, 50).otherwise(20)
    density = F.when(answer_cue(F.col("body")), 80).otherwise(share(count_where("_t", is_fact), F.greatest(n, F.lit(1))))
    specific = share(count_where("_t", lambda x: is_specific(x, 7)), F.greatest(n, F.lit(1)))
    scored = c.select(*[x for x in chunks.columns if x not in ("heading", "body") or x in keep], n.alias("n_tokens"), F.when(n > 0, share(F.size(F.array_distinct("_t")), n)).otherwise(0).alias("cohesion"), contained.alias("self_contained"), density.alias("answer_density"), specific.alias("specificity"))
    return scored.withColumn("citation_suitability", F.floor((F.col("self_contained") + F.col("specificity") + F.col("answer_density")) / 3).cast("int"))


def intent_hits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, intent, mask, questions``: the answered phrases of each intent as bits. The lowered text is made once."""
    low = _texts(docs, key, text).select(key, F.array(ascii_lower(F.col("_text"))).alias("_low"))
    bits = lambda phrases, t: sum((F.when(t.contains(p), 1 << i).otherwise(0) for i, p in enumerate(phrases)), F.lit(0))
    rows = F.flatten(F.transform("_low", lambda t: F.array(*[F.struct(F.lit(i).alias("intent"), bits(ps, t).alias("mask"), F.lit(len(ps)).alias("questions")) for i, ps in INTENTS.items()])))
    return low.select(key, F.explode(rows).alias("_i")).select(key, "_i.*")


def intent_coverage(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Answered phrases of each intent per text, as a/n."""
    n = F.bit_count("mask")
    return intent_hits(docs, key, text).select(key, "intent", n.alias("answered"), "questions", F.concat_ws("/", n.cast("string"), F.col("questions").cast("string")).alias("coverage"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of each text that occurs more than once: ``key, class_id, n_copies``.

    Texts meet by a 128-bit digest, so whole texts aren't shuffled; class_id is the
    smallest key. Blank and null texts are no duplicates. Copies stay rows of a class: no pairs.
    """
    t = _texts(docs, key, text).where(F.trim("_text") != "").select(key, F.md5(F.encode("_text", "utf-8")).alias("_h"))
    g = t.groupBy("_h").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return t.join(g, "_h").select(key, "class_id", "n_copies")


def shared_vocabulary(docs: DataFrame, family: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per family of at least two texts: texts, distinct tokens, and tokens that all of them share."""
    t = docs.where(F.col(text).isNotNull()).select(key, family.alias("family"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("_t")).where("family IS NOT NULL")
    sizes = docs.where(F.col(text).isNotNull()).select(key, family.alias("family")).where("family IS NOT NULL").groupBy("family").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts >= 2")
    words_ = t.groupBy("family", "_t").agg(F.count(F.lit(1)).alias("c"))
    return words_.join(sizes, "family").groupBy("family", "n_texts").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("c") == F.col("n_texts")).alias("n_shared"))


def family_shares(pages: DataFrame, family: Column, city: Column, key: str = "url", text: str = "text", schema_blocks: str = "json_ld") -> DataFrame:
    """What families of pages share, substitute and say for themselves, in floor percent.

    Distinct tokens of a page are shared (on every page of the family), substituted (part of the
    city's name), facts of its own, or other; shares are of all pages' distinct tokens. Tokens are counted per family before
    anything meets, and a page's own numbers are sums, so no family is a single task.
    """
    p = pages.where(F.trim(text) != "").select(key, family.alias("family"), city.alias("_city"), F.array_distinct(tokens(F.col(text))).alias("_t"), (F.coalesce(F.size(schema_blocks), F.lit(0)) > 0).alias("_schema")).where("family IS NOT NULL")
    p = p.withColumn("_c", tokens(F.replace(F.coalesce("_city", F.lit("")), F.lit("-"), F.lit(" "))))
    local = F.exists("_t", lambda t: is_fact(t) & ~F.array_contains("_c", t))
    heads = p.groupBy("family").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.size("_t")).alias("n_tokens"), F.count_if(local).alias("_local"), F.count_if("_schema").alias("_with"), F.min(key).alias("first_page"))
    each = p.select("family", "_c", F.explode("_t").alias("t")).select("family", "t", F.array_contains("_c", F.col("t")).cast("int").alias("param"))
    kinds = each.groupBy("family", "t").agg(F.count(F.lit(1)).alias("c"), F.sum("param").alias("param"))
    shared = F.col("c") == F.col("n_pages")
    own = F.when(~shared, F.col("c") - F.col("param")).otherwise(0)
    g = kinds.join(heads, "family").groupBy("family", "n_pages", "n_tokens", "_local", "_with", "first_page").agg(
        F.sum(F.when(shared, F.col("c")).otherwise(0)).alias("_s"), F.sum(F.when(~shared, F.col("param")).otherwise(0)).alias("_p"), F.sum(F.when(is_fact(F.col("t")), own).otherwise(0)).alias("_f"), F.sum(F.when(~is_fact(F.col("t")), own).otherwise(0)).alias("_o")
    )
    of = lambda c, whole: share(F.col(c), F.col(whole))
    return g.select(
        "family", F.col("n_pages").alias("measured_urls"), of("_s", "n_tokens").alias("template_shared_ratio"), of("_p", "n_tokens").alias("parameter_substitution_ratio"), of("_f", "n_tokens").alias("unique_fact_ratio"),
        of("_o", "n_tokens").alias("unique_semantic_ratio"), of("_local", "n_pages").alias("local_fact_coverage"), of("_with", "n_pages").alias("schema_fact_coverage"), "first_page",
    )


def template_families(shares: DataFrame) -> DataFrame:
    """CONTENT-003: families of two or more pages that share 70 % of their words and say less than 15 % in facts of their own."""
    hit = (F.col("measured_urls") >= 2) & (F.coalesce("template_shared_ratio", F.lit(0)) >= 70) & (F.coalesce("unique_fact_ratio", F.lit(100)) < 15)
    return shares.where(hit).select(F.lit("SE-CONTENT-003").alias("code"), F.lit("CONTENT").alias("family"), F.lit("warn").alias("severity"), F.col("first_page").alias("url"), F.col("family").alias("subject"))
