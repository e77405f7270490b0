"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import cut_lineage, prefix_offsets
from .tokens import VOCABULARY, count_tokens

EXACT_BELOW = 10**9  # numpy draws hypergeometric counts for fewer blocks than this

SHARDS_A_TASK = 4


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, trimmed, words joined by hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), "[\\s_-]+", "-")


@dataclass(frozen=True)
class Share:
    """A source's part in the mix, in blocks."""

    source: str
    target: float
    blocks: int  # that its documents fill
    drawn: int  # that the mix takes, repeats included
    repeats: int


def plan_shares(sources: list[tuple[str, float, int, int]], full_weight: float) -> list[Share]:
    """Blocks to draw from each (source, target share, max repeats, blocks at hand).

    The mix is made as large as it can be while sources that carry ``full_weight`` of the
    target keep their share. A source that runs short before that gives all it may, repeats
    included, and the others split the rest in proportion to their targets. With
    full_weight 1 no source with documents runs short. Sources without documents draw 0.
    """
    cap = {s: float(r * b) for s, _, r, b in sources}
    live = sorted((x for x in sources if cap[x[0]] > 0 and x[1] > 0), key=lambda x: (cap[x[0]] / x[1], x[0]))
    weight = sum(x[1] for x in live)
    short: set[str] = set()
    gone = 0.0
    for s, w, _, _ in live:
        if weight - gone - w < full_weight * weight - 1e-12:
            break
        short.add(s)
        gone += w
    rest = [x for x in live if x[0] not in short]
    unit = min((cap[s] / w for s, w, _, _ in rest), default=0.0)  # blocks per unit of target
    drawn = {s: int(min(cap[s], w * unit)) for s, w, _, _ in live}
    return [Share(s, w, b, drawn.get(s, 0), r) for s, w, r, b in sources]


def permute(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1, evaluated at ``index``: a Feistel network over
    the next even power of two, walked until it falls back into the range."""
    if size <= 1:
        return index.copy()
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed & 0xFFFFFFFFFFFF).integers(1, 2**62, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    while (out := x >= np.uint64(size)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def draw_without_replacement(rng: np.random.Generator, total: np.ndarray, n: int) -> np.ndarray:
    """How many blocks of each source are among n drawn from all, for any number of blocks."""
    blocks = int(total.sum())
    if blocks < EXACT_BELOW:
        return rng.multivariate_hypergeometric(total, n, method="marginals")
    # Each block is taken or not by itself; those too many or too few, about the root of n, are then
    # picked one by one. All sets of n blocks stay equally likely, so the distribution is the same.
    got = rng.binomial(total, n / blocks)
    surplus = int(got.sum()) - n
    pool = got if surplus > 0 else total - got
    picked = np.empty(0, np.int64)
    while len(picked) < abs(surplus):
        new = np.r_[picked, rng.integers(0, int(pool.sum()), abs(surplus) - len(picked))]
        picked = new[np.sort(np.unique(new, return_index=True)[1])]
    moved = np.bincount(np.searchsorted(np.cumsum(pool), picked, side="right"), minlength=len(pool))
    return got - moved if surplus > 0 else got + moved


def shard_counts(totals: np.ndarray, shard: int, n_shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source in a shard, blocks of each source in all earlier shards).

    The multinomial of the shard's draws, conditioned on the totals so that the mix meets
    them exactly: the range of shards is halved again and again, and the blocks of the left
    half are drawn without replacement (a seed per half, so any shard can be found alone).
    """
    total, before, a, b = totals.copy(), np.zeros_like(totals), 0, n_shards
    blocks = int(totals.sum())
    while b - a > 1:
        m = (a + b) // 2
        left_size = min(m * size, blocks) - a * size
        left = draw_without_replacement(np.random.default_rng([seed, a, b]), total, left_size)
        if shard < m:
            total, b = left, m
        else:
            before, total, a = before + left, total - left, m
    return total, before


def source_blocks(docs: DataFrame, weights: DataFrame, block: int, key: str, text: str, source: str, vocabulary: str, buckets: int) -> DataFrame:
    """``source, doc_id, n_tokens, start``: listed documents at their place in their source's
    token stream. Documents without tokens, without a source or of a source that isn't
    listed are left out."""
    listed = weights.where("source IS NOT NULL").select(source_name(F.col("source")).alias("_name")).distinct()
    named = docs.select(F.col(key), source_name(F.col(source)).alias("_source"), F.col(text))
    kept = named.join(listed, named["_source"] == listed["_name"], "left_semi")
    sized = cut_lineage(count_tokens(kept, text, vocabulary).where("n_tokens > 0"))
    based = prefix_offsets(sized, ["_source"], F.col("n_tokens"), F.col(key), buckets)
    w = Window.partitionBy("_source", "_bucket").orderBy(key)
    return based.select(F.col("_source").alias("source"), key, "n_tokens", (F.col("_base") + F.sum("n_tokens").over(w) - F.col("n_tokens")).alias("start"))


def mix_sources(
    docs: DataFrame, weights: DataFrame, full_weight: float = 0.8, block: int = 256, shard: int = 1024, seed: int = 7,
    key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, buckets: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``shard, slot, source, block_no, repeat_no, doc_id, token_start, n_tokens``, one row
    per stretch of a document in a drawn block. Report: ``source, target_share, n_documents,
    source_tokens, drawn_tokens, actual_share, most_repeats, exhausted``, one row per listed source.

    Tokens of a source are packed into blocks of ``block`` tokens (the last one may be
    shorter). plan_shares() gives each source's blocks, shard_counts() how many of them each output
    shard holds. The n-th draw of a source is block permute(n mod blocks) of
    repeat n // blocks, so no block, and hence no document, is used more than max_repeats
    times, and draws differ before any repeats. Slots meet blocks by (source, index).

    Weights may list a source twice (the first by spelling counts) or with a null share or
    repeats (0 and 1). Only one row per listed source reaches the driver.
    """
    spark = docs.sparkSession
    placed = source_blocks(docs, weights, block, key, text, source, vocabulary, buckets)
    want = weights.where("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(
        F.min_by(F.coalesce("target_share", F.lit(0.0)), "source").alias("target_share"), F.min_by(F.coalesce("max_repeats", F.lit(1)), "source").alias("max_repeats")
    )
    totals = placed.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    rows = want.join(totals, "source", "left").orderBy("source").collect()  # one per listed source
    size = {r["source"]: (r["t"] or 0, r["n"] or 0) for r in rows}
    plan = plan_shares([(r["source"], r["target_share"], r["max_repeats"], -(-size[r["source"]][0] // block)) for r in rows], full_weight)
    drawn = np.array([p.drawn for p in plan], np.int64)
    n_shards = max(1, -(-int(drawn.sum()) // shard))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"]:
                counts, before = shard_counts(drawn, int(s), n_shards, shard, seed)
                place = np.random.default_rng([seed, 1, int(s)]).permutation(int(counts.sum()))
                at, parts = 0, []
                for i, p in enumerate(plan):
                    n = int(counts[i])
                    if not n:
                        continue
                    draw = before[i] + np.arange(n)
                    repeat, index = draw // p.blocks, draw % p.blocks
                    number = np.empty(n, np.int64)
                    for k in np.unique(repeat):
                        number[repeat == k] = permute(index[repeat == k], p.blocks, seed * 1_000_003 + i * 1009 + int(k))
                    parts.append(pd.DataFrame({"shard": int(s), "slot": place[at : at + n], "source": p.source, "block_no": number, "repeat_no": repeat}))
                    at += n
                if parts:
                    yield pd.concat(parts)

    drawn_slots = spark.range(n_shards if drawn.sum() else 0, numPartitions=max(1, -(-n_shards // SHARDS_A_TASK))).mapInPandas(slots, "shard long, slot long, source string, block_no long, repeat_no long")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)
    stretches = placed.select("source", key, "start", "n_tokens", F.explode(F.sequence(first, last)).alias("block_no"))
    begin = F.greatest(F.col("start"), F.col("block_no") * block)
    stop = F.least(F.col("start") + F.col("n_tokens"), (F.col("block_no") + 1) * block)
    stretches = stretches.select("source", "block_no", key, (begin - F.col("start")).alias("token_start"), (stop - begin).alias("n_tokens"))
    # Spark sizes the slots by the few rows of range(): without the hint it would broadcast them, however many
    mix = drawn_slots.hint("merge").join(stretches, ["source", "block_no"]).select("shard", "slot", "source", "block_no", "repeat_no", key, "token_start", "n_tokens")

    used = mix.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    facts = spark.createDataFrame([(p.source, float(p.target), size[p.source][1], size[p.source][0], bool(p.drawn == p.blocks * p.repeats)) for p in plan] or [], "source string, target_share double, n_documents long, source_tokens long, exhausted boolean")
    everything = F.sum(F.coalesce("drawn_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # over one row per listed source
    report = facts.join(used, "source", "left").withColumn("_all", everything).select(
        "source", "target_share", "n_documents", "source_tokens", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
        F.round(F.coalesce("drawn_tokens", F.lit(0)) / F.nullif(F.col("_all"), F.lit(0)), 6).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "exhausted",
    )
    return mix, report
