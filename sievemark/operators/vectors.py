"""Search over vectors in blocks, and the lexical embedding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.hashing import fnv
from ..functions.measures import cosine
from ..functions.text import ascii_lower, intent_tokens, tokens
from ..functions.urls import segments

DIM = 64


def _blocks(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Batches of unit vectors as one row each: ids and a float32 matrix in bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
                keep = [i for i, v in enumerate(rows) if v and all(x is not None for x in v)]
                by_dim: dict[int, list[int]] = {}
                for i in keep:
                    by_dim.setdefault(len(rows[i]), []).append(i)
                for dim, at_rows in by_dim.items():
                    m = np.array([rows[i] for i in at_rows], np.float64)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = m / np.where(norm == 0, 1, norm)
                    yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([[ids[i] for i in at_rows]], pa.list_(pa.int64())), pa.array([m.tobytes()])], names=["dim", f"{name}_ids", name])

    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(pack, f"dim long, {name}_ids array<long>, {name} binary")


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int | None = 10, least: float = -1.0, lots: int | None = None) -> DataFrame:
    """``query_id, hit_id, cosine, rank``: the k nearest other rows of each query, at least ``least``; without a k all of them, and no rank.

    Exact, in blocks: every block of 2048 queries meets every block of 2048 rows as one
    matrix product that keeps k hits per query and block; the merge sees k rows per block. Equal cosines
    (after rounding to 9 digits) go to the smaller id. Null vectors, vectors with nulls and vectors of another
    length meet nothing; a zero vector has cosine 0 with all. Row blocks are dealt to ``lots`` lots, one
    for every 16 blocks unless told otherwise, but at least one per shuffle partition; each lot sees all query blocks.
    """
    if lots is None:
        lots = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (16 * 2048)))
    q, v = _blocks(queries, key, vector, "q"), _blocks(df, key, vector, "v")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qi, vi = np.array(r["q_ids"], np.int64), np.array(r["v_ids"], np.int64)
                s = np.round(np.frombuffer(r["q"], np.float64).reshape(len(qi), -1) @ np.frombuffer(r["v"], np.float64).reshape(len(vi), -1).T, 9)
                s[qi[:, None] == vi[None, :]] = -np.inf
                if k is None:
                    i, j = np.nonzero(s >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(vi[j]), pa.array(s[i, j])], names=["query_id", "hit_id", "cosine"])
                    continue
                order = np.lexsort((np.broadcast_to(vi, s.shape), -s), axis=1)[:, :k]
                top = np.take_along_axis(s, order, 1)
                ok = (top >= least).ravel() & np.isfinite(top).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, order.shape[1])[ok]), pa.array(vi[order].ravel()[ok]), pa.array(top.ravel()[ok])], names=["query_id", "hit_id", "cosine"])

    # all blocks of a length would meet under one key: row blocks are dealt to lots, query blocks (one
    # part in a hundred, say) go to every lot; nothing is broadcast
    v = v.withColumn("lot", F.pmod(F.xxhash64(F.col("v_ids")[0]), F.lit(lots)).cast("int"))
    q = q.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    hits = q.hint("merge").join(v, ["dim", "lot"]).select("q_ids", "q", "v_ids", "v").mapInArrow(multiply, "query_id long, hit_id long, cosine double")
    if k is None:
        return hits
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "hit_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


@F.arrow_udf(ArrayType(FloatType()))
def lexical_embedding(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """64-dimensional signed token hash of arrays of tokens; null without tokens. Each distinct token of a batch is hashed once."""
    slots: dict[str, tuple[int, int]] = {}
    for s in lists:
        words = s.flatten().dictionary_encode()
        at = np.zeros((len(words.dictionary), 2), np.int64)
        for i, t in enumerate(words.dictionary.to_pylist()):
            known = slots.get(t)
            if known is None:
                if len(slots) > 200_000:
                    slots.clear()
                known = slots[t] = slot_of(t)
            at[i] = known
        sizes = np.nan_to_num(np.asarray(pc.fill_null(pc.list_value_length(s), 0), np.int64))
        rows = np.repeat(np.arange(len(s)), sizes)
        v = np.zeros((len(s), DIM), np.float32)
        codes = np.asarray(words.indices)
        np.add.at(v, (rows, at[codes, 0]), at[codes, 1].astype(np.float32))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), DIM).cast(pa.list_(pa.float32()))
        yield pc.if_else(pa.array(sizes > 0), flat, pa.nulls(len(s), pa.list_(pa.float32())))


def slot_of(token: str) -> tuple[int, int]:
    """Place and sign of a token in the lexical embedding."""
    h = f"{fnv(token.encode()):032x}"
    return int(h[:4], 16) % DIM, 1 if ord(h[4]) % 2 == 0 else -1


def query_tokens(query: str) -> list[str]:
    """Tokens of a query, as functions.text.tokens() cuts texts."""
    import re

    return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.split(r"[\W_]+", query) if len(w.encode()) >= 2]


def query_embedding(query: str) -> list[float] | None:
    """Lexical embedding of one query; None without tokens."""
    asked = query_tokens(query)
    return embedding_of(asked) if asked else None


def embedding_of(asked: list[str]) -> list[float]:
    """Lexical embedding of tokens."""
    v = [0.0] * DIM
    for t in asked:
        at, sign = slot_of(t)
        v[at] += sign
    return v


def _percent(vector: Column, query: list[float]) -> Column:
    """Cosine with a query's vector in whole percent; 0 where negative."""
    return F.coalesce(F.round(100 * F.greatest(cosine(vector, F.array(*map(F.lit, query))), F.lit(0.0))), F.lit(0)).cast("int")


def _present(text: Column, words: list[str]) -> Column:
    """How many words a text contains; the lowered text is made once. Words hold no white space and are one literal: a sum of one term a word nests too deep for Spark from some 500 on."""
    some = F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")
    return F.transform(F.array(ascii_lower(text)), lambda low: F.size(F.filter(some, lambda t: low.contains(t))))[0]


def holder(asked: list[str]) -> Callable[[str], list[int]]:
    """For a token of a text: the places (in the order of ``dict.fromkeys(asked)``) of the asked tokens inside it.

    Costs the lesser of one lookup per part of a possible length and one search per asked token.
    """
    place = {t: i for i, t in enumerate(dict.fromkeys(asked))}
    sizes = sorted({len(t) for t in place})

    def inside(word: str) -> list[int]:
        n = len(word)
        if len(place) < n * len(sizes):
            return [i for t, i in place.items() if t in word]
        parts = {word[i : i + m] for m in sizes if m <= n for i in range(n - m + 1)}
        return [place[x] for x in parts if x in place]

    return inside


def _held(words: Column, asked: list[str]) -> Column:
    """``entities, present``: how many of the asked tokens a text contains, those of more than three bytes and all, from the text's tokens.

    An asked token is a run of letters and digits, so a text contains it only inside a token. What a token holds is found
    once per worker and distinct token, so the cost hardly depends on how many are asked; one asked twice counts twice.
    """
    times = Counter(asked)
    inside = holder(asked)
    all_of = np.array(list(times.values()), np.int64)
    long_of = np.array([n if len(t.encode()) > 3 else 0 for t, n in times.items()], np.int64)

    @F.arrow_udf("struct<entities: int, present: int>")
    def held(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, list[int]] = {}
        kept = 0
        for s in lists:
            words = s.flatten().dictionary_encode()
            found = []
            for t in words.dictionary.to_pylist():
                places = seen.get(t)
                if places is None:
                    if kept > 2_000_000:
                        seen.clear()
                        kept = 0
                    places = seen[t] = inside(t)
                    kept += 10 + len(places)
                found.append(places)
            n_of = np.array([len(x) for x in found], np.int64)
            ids = np.array([i for x in found for i in x], np.int64)
            starts, codes = np.cumsum(n_of) - n_of, np.asarray(words.indices)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(s), 0), np.int64)
            ends = np.cumsum(sizes)
            out = np.zeros((2, len(s)), np.int32)
            at = 0
            while at < len(s):  # whole rows of about a million tokens at a time
                begin = ends[at] - sizes[at]
                to = max(at + 1, int(np.searchsorted(ends, begin + 1_000_000, "right")))
                rows = np.repeat(np.arange(to - at), sizes[at:to])
                pairs = np.unique(rows * len(n_of) + codes[begin : ends[to - 1]]) if len(rows) else np.zeros(0, np.int64)
                row, code = np.divmod(pairs, max(len(n_of), 1))
                n = n_of[code]
                each = np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hits = np.unique(np.repeat(row, n) * max(len(all_of), 1) + ids[each])
                row, asked_at = np.divmod(hits, max(len(all_of), 1))
                for k, weight in enumerate((long_of, all_of)):
                    out[k, at:to] = np.bincount(row, weight[asked_at], to - at)
                at = to
            yield pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["entities", "present"])

    return held.asNondeterministic()(words)  # else conditions on scores move below them and texts are scored twice


def _best(docs: DataFrame, asked: list[str], k: int, key: str, text: str) -> DataFrame:
    """``retrieve`` for tokens as tokens() cuts them."""
    words = tokens(F.col(text))
    some = docs.where(F.col(text).isNotNull()).where(F.size(words) > 0)
    if not asked:
        return some.select(key, F.lit(0).alias("lexical"), F.lit(0).alias("entities")).where("false")
    scored = some.select(key, _percent(lexical_embedding(words), embedding_of(asked)).alias("lexical"), _held(words, asked).alias("_held"))
    found = scored.where("lexical >= 40 OR _held.present > 0").select(key, "lexical", F.col("_held.entities").alias("entities"))
    return found.orderBy(F.desc("lexical"), F.desc("entities"), key).limit(min(max(k, 1), 50))


def retrieve(docs: DataFrame, query: str, k: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best texts for a query: ``key, lexical, entities``.

    lexical is the cosine of lexical embeddings in percent; a text is kept at 40 or more or if it contains a
    query token. Order: lexical, then entities (query tokens of more than three bytes in
    the text), then key. k is brought between 1 and 50. Only scores are sorted, not texts. A query without tokens finds nothing; it is cut as texts are, and may be as long as a text.
    """
    asked = docs.sparkSession.range(1).select(tokens(F.lit(query))).first()[0]
    return _best(docs, asked, k, key, text)


def similar(docs: DataFrame, of: object, k: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts most like that of one key: its own text is the query, and it is then left out, so there may be k - 1."""
    own = docs.where(F.col(key) == F.lit(of)).select(tokens(F.col(text))).first()  # one text
    return _best(docs, (own[0] or []) if own else [], k, key, text).where(F.col(key) != F.lit(of))


def chunks_for(chunks: DataFrame, query: str, k: int = 8, text: str = "body", order: tuple[str, ...] = ("url", "chunk_no")) -> DataFrame:
    """The k chunks nearest to a query, with ``relevance`` in percent; equal ones in their order. A
    query without tokens gives the first k chunks without relevance."""
    vector = query_embedding(query)
    if vector is None:
        return chunks.withColumn("relevance", F.lit(None).cast("int")).orderBy(*order).limit(max(k, 0))
    words = tokens(F.col(text))
    return chunks.where(F.size(words) > 0).withColumn("relevance", _percent(lexical_embedding(words), vector)).orderBy(F.desc("relevance"), *order).limit(min(max(k, 1), 50))


def passage_gaps(rows: DataFrame, chunks: DataFrame, least: int = 40) -> DataFrame:
    """CONTENT-004: searches of 30 impressions whose words no chunk of their page covers by ``least`` percent.

    ``rows`` are current observations, ``chunks`` url, heading, body. Words are runs of letters and digits of three
    bytes and more; the subject is the query.
    """
    words = F.filter(F.transform(F.split("query", "[^\\p{L}\\p{N}]+"), ascii_lower), lambda x: F.octet_length(x) >= 3)
    asked = rows.where("kind = 'search_performance' AND impressions >= 30 AND octet_length(query) > 3 AND url IS NOT NULL").select("row_id", "url", "query", F.regexp_replace("url", "/+$", "").alias("_k"), words.alias("_w")).where(F.size("_w") > 0)
    pairs = asked.select("_k", "query", "_w").distinct()
    parts = chunks.select(F.regexp_replace("url", "/+$", "").alias("_k"), ascii_lower(F.concat_ws(" ", "heading", "body")).alias("_hay"))
    best = pairs.join(parts, "_k").groupBy("_k", "query").agg(F.max(F.floor(F.size(F.filter("_w", lambda w: F.instr(F.col("_hay"), w) > 0)) * 100 / F.size("_w"))).cast("int").alias("best"))
    j = asked.join(best, ["_k", "query"], "left").withColumn("best", F.coalesce("best", F.lit(0))).where(F.col("best") < least)
    return j.select("row_id", F.lit("SE-CONTENT-004").alias("code"), F.lit("info").alias("severity"), "url", F.col("query").alias("subject"), "best")


def same_intent(p: DataFrame, links: DataFrame, least: float = 0.86) -> DataFrame:
    """CANN-001: pages whose texts and headings ask for the same. ``links`` are pairs ``a, b, cosine`` of pages (nearest() over lexical embeddings).

    Pairs need a cosine of ``least``, different texts, two words in common in their first heading of level 1 (else title), and must not be different
    services in one town. Both orders of a pair are one finding, at the first URL.
    """
    h1 = F.coalesce(F.try_element_at(F.filter("headings", lambda h: h["level"] == 1), F.lit(1))["text"], F.col("title"), F.lit(""))
    page = p.where("_ok").select(F.col("_url").alias("u"), segments(F.col("_path")).alias("s"), F.array_distinct(intent_tokens(h1)).alias("t"), F.md5(F.encode("text", "utf-8")).alias("h"))
    one, two = page.select([F.col(c).alias(f"{c}1") for c in page.columns]), page.select([F.col(c).alias(f"{c}2") for c in page.columns])
    pairs = links.where(F.col("cosine") >= least).select(F.least("a", "b").alias("u1"), F.greatest("a", "b").alias("u2")).where("u1 <> u2").distinct()
    j = pairs.join(one, "u1").join(two, "u2")
    last = lambda s, i: F.try_element_at(s, F.lit(-i))
    town = (F.size("s1") >= 3) & (F.size("s1") == F.size("s2")) & (last("s1", 1) == last("s2", 1)) & (last("s1", 2) != last("s2", 2)) & (last("s1", 1).contains("-") | F.array_contains("s1", "category"))
    hit = j.where("h1 <> h2").where(F.size(F.array_intersect("t1", "t2")) >= 2).where(~F.coalesce(town, F.lit(False)))
    return hit.select(F.lit("SE-CANN-001").alias("code"), F.lit("CANN").alias("family"), F.lit("warn").alias("severity"), F.col("u1").alias("url"), F.col("u2").alias("subject"))


def link_profiles(p: DataFrame, ranks: DataFrame) -> DataFrame:
    """``url, site, canonical, language, cornerstone, orphan`` of indexable pages with text: what a link policy asks of them."""
    r = ranks.select(F.col("node").alias("_url"), "rank")
    j = p.where("_ok").where(F.size(tokens(F.col("text"))) > 0).join(r, "_url", "left")
    return j.select(F.col("_url").alias("url"), F.col("_host").alias("site"), F.coalesce("canonical", "_url").alias("canonical"), F.col("html_lang").alias("language"), ((F.coalesce("rank", F.lit(0.0)) > 0.15) | F.col("_url").endswith("/")).alias("cornerstone"), (~F.col("_linked") & (F.col("_path") != "/")).alias("orphan"))


def recommend_links(profiles: DataFrame, near: DataFrame, existing: DataFrame, least: float = 0.12, most: int = 3) -> DataFrame:
    """LINK-004: up to ``most`` links a page lacks: ``url, target, cosine, rank, severity``.

    ``near`` are pairs a, b, cosine. Both pages are of one site, of one language where both are known, different canonicals,
    not linked yet, and of a cosine of at least ``least``; equal ones go to the first URL. A link to an orphan is a warning.
    """
    s, t = (profiles.select([F.col(c).alias(f"{x}_{c}") for c in profiles.columns]) for x in ("s", "t"))
    j = near.where(F.col("cosine") >= least).join(s, F.col("a") == F.col("s_url")).join(t, F.col("b") == F.col("t_url"))
    ok = (F.col("s_site") == F.col("t_site")) & (F.col("s_url") != F.col("t_url")) & (F.col("s_canonical") != F.col("t_canonical")) & F.coalesce(F.col("s_language") == F.col("t_language"), F.lit(True))
    new = j.where(ok).join(existing.select(F.col("src").alias("s_url"), F.col("dst").alias("t_url")).distinct(), ["s_url", "t_url"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("s_url").orderBy(F.desc("cosine"), "t_url"))
    return new.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("s_url").alias("url"), F.col("t_url").alias("target"), "cosine", "rank", F.when(F.col("t_orphan"), "warn").otherwise("info").alias("severity"))


def anchor_texts(recommended: DataFrame, p: DataFrame) -> DataFrame:
    """Adds ``anchor``: the target's first heading (else its title) where the source's text contains it, else that heading as a suggestion (``found`` false)."""
    h1 = F.coalesce(F.try_element_at(F.filter("headings", lambda h: h["level"] == 1), F.lit(1))["text"], F.col("title"))
    target, source = p.select(F.col("_url").alias("target"), h1.alias("anchor")), p.select(F.col("_url").alias("url"), F.col("text").alias("_text"))
    j = recommended.join(target, "target", "left").join(source, "url", "left")
    return j.withColumn("found", F.coalesce(ascii_lower(F.col("_text")).contains(ascii_lower(F.col("anchor"))), F.lit(False))).drop("_text")


def keyword_retrieve(docs: DataFrame, query: str, k: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same without embeddings: texts by how many query tokens they contain."""
    asked = sorted(set(query_tokens(query)))
    return docs.where(F.col(text).isNotNull()).select(key, _present(F.col(text), asked).alias("entities")).where("entities > 0").orderBy(F.desc("entities"), key).limit(min(max(k, 1), 50))
