"""Texts that nearly repeat each other, exactly by shared word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bands, minhash
from ..functions.text import shingles, tokens
from .common import cut_lineage
from .graph import components

BLOCK = 2000  # texts of one shingle that meet in one task


def shingle_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``key, set_id, n``, and the distinct 64-bit shingle hashes ``s`` of each text with tokens."""
    # tokens are a column of their own: inside the shingles' lambda they'd be made anew for every shingle
    toks = docs.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("_t"))
    sets = toks.select(key, F.array_sort(F.array_distinct(F.transform(shingles(F.col("_t"), width), lambda x: F.xxhash64(x)))).alias("s")).where(F.size("s") > 0)
    return sets.withColumn("set_id", F.xxhash64("s")).withColumn("n", F.size("s"))


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, membership): all pairs of different shingle sets with a Jaccard of at least the
    threshold as ``a, b, common, similarity`` with a < b, and ``key, rep`` for every text with tokens.

    Texts with equal sets are one representative, so copies give no pairs. Two sets that
    similar must share one of the n - ceil(threshold * n) + 1 rarest shingles of each, so only those are
    joined (rare first by corpus counts, so a shingle of boilerplate is reached by texts that
    have nothing rarer), lengths must fit, and the exact intersection decides. No link is lost.
    """
    sets = cut_lineage(shingle_sets(docs, key, text, width))
    first = sets.groupBy("set_id").agg(F.min(key).alias("rep"))
    member = sets.select(key, "set_id").join(first, "set_id").select(key, "rep")
    reps = sets.groupBy("set_id").agg(F.min(key).alias("rep"), F.first("s").alias("s"), F.first("n").alias("n")).select("rep", "s", "n")
    each = reps.select("rep", "n", F.explode("s").alias("h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    shared = each.join(counts.where("c > 1"), "h")  # a shingle of one set alone meets nothing
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("c", "h"))
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("rep"))
    prefix = shared.withColumn("_k", rank + alone).where(F.col("_k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("rep", "n", "h")
    return _links(_candidates(prefix, threshold), reps, threshold), member


def _candidates(posted: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of sets (rep, n) that share a key h and whose sizes allow the similarity.

    A key that more than BLOCK sets have is cut into blocks; every two blocks of it meet under a key of their own.
    """
    blocks = posted.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    dealt = posted.join(blocks, "h").withColumn("_i", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    x = dealt.select(F.col("rep").alias("a"), F.col("n").alias("na"), "h", "_i", every.alias("_j"))
    y = dealt.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "h", F.col("_i").alias("_j"), every.alias("_i"))
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (F.col("a") < F.col("b"))
    return x.join(y, ["h", "_i", "_j"]).where(fits).select("a", "b").distinct()


def _links(candidates: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose exact similarity reaches the threshold."""
    left, right = reps.select(F.col("rep").alias("a"), F.col("s").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    jaccard = F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))
    links = candidates.join(left, "a").join(right, "b").withColumn("common", common).withColumn("similarity", jaccard).where(F.col("similarity") >= threshold - 1e-12)
    return links.select("a", "b", "common", "similarity")


def minhash_links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The links of similar_pairs() by another way: sets that share one of 16 bands of a MinHash signature are
    compared exactly. Every link it gives is one; it misses one of 0.8 similarity in some 4 000, more of those just below."""
    sets = cut_lineage(shingle_sets(docs, key, text, width))
    reps = sets.groupBy("set_id").agg(F.min(key).alias("rep"), F.first("s").alias("s"), F.first("n").alias("n")).select("rep", "s", "n")
    posted = reps.select("rep", "n", F.explode(bands(minhash(F.col("s")))).alias("h"))
    return _links(_candidates(posted, threshold), reps, threshold)


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``key, class_id, n_links``: the class of every text, by links between representatives and
    their connected components. class_id is the smallest key of the class, n_links the
    links of the text's representative; a text like no other is its own class, as is one without tokens."""
    links, member = similar_pairs(docs, key, text, width, threshold)
    links = cut_lineage(links)
    classes = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    found = member.join(classes.join(degree, "node"), member["rep"] == F.col("node"), "left").select(key, F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    bare = docs.select(key, F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("_n")).where("_n <= 0")
    return found.unionByName(bare.select(key, F.col(key).alias("class_id"), F.lit(0).cast(found.schema["n_links"].dataType).alias("n_links")))
