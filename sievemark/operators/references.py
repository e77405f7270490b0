"""References to records that don't exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1000  # the commonest keys, answered by broadcast; any other key has less than a thousandth of all references
HEAVY_SPANS = 100  # lifetimes that a heavy key may have in the broadcast: at most HEAVY_KEYS * HEAVY_SPANS in all


def _joined(spans: Column) -> Column:
    """Sorted lifetimes with those that touch or overlap made one."""

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & (x["a"] <= F.try_element_at(acc, F.lit(-1))["b"])
        merged = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    s = F.sort_array(spans)
    return F.when(F.size(s) < 2, s).otherwise(F.aggregate(s, F.slice(s, 1, 0), join))


def lifetimes(nodes: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row per key: ``_key, _first`` (earliest start) and ``_spans``, its disjoint lifetimes.

    Repeated, touching and overlapping lifetimes are made one, first per key and day of
    start, then per key, so a key with a third of all rows is no single task and no long list. A null end
    is open; rows without a key or a start are left out, as are lifetimes that end before they begin.
    """
    known = nodes.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key).alias("_key"), F.col(start).alias("_a"), F.col(end).alias("_b"), F.to_date(start).alias("_day"))
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz" if dict(known.dtypes)["_a"] == "timestamp_ntz" else "timestamp")
    span = F.when(F.col("_b").isNull() | (F.col("_b") > F.col("_a")), F.struct(F.col("_a").alias("a"), F.coalesce("_b", far).alias("b")))
    by_day = known.groupBy("_key", "_day").agg(F.min("_a").alias("_first"), F.collect_set(span).alias("_l")).select("_key", "_first", _joined(F.col("_l")).alias("_l"))
    return by_day.groupBy("_key").agg(F.min("_first").alias("_first"), F.flatten(F.collect_list("_l")).alias("_l")).select("_key", "_first", _joined(F.col("_l")).alias("_spans"))


def asked_only(refs: DataFrame, ref: str, at: str) -> DataFrame:
    """References that count: with a key that isn't empty, and a time."""
    return refs.where(F.col(ref).isNotNull() & (F.col(ref) != "") & F.col(at).isNotNull())


def key_periods(refs: DataFrame, ref: str, at: str) -> DataFrame:
    """``_key, _period, n``: references per key and month, combined before the shuffle."""
    return refs.groupBy(F.col(ref).alias("_key"), F.date_trunc("month", F.col(at)).alias("_period")).agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(refs: DataFrame, ref: str, at: str, most: int = HEAVY_KEYS) -> DataFrame:
    """``_hot``: the ``most`` commonest keys of at least two references, as a table of the driver."""
    per_key = key_periods(refs, ref, at).groupBy("_key").agg(F.sum("n").alias("n")).where("n > 1")
    rows = per_key.orderBy(F.desc("n"), "_key").limit(most).collect()  # at most ``most`` rows
    return refs.sparkSession.createDataFrame([(r["_key"],) for r in rows], "_hot string")


def _split(refs: DataFrame, nodes: DataFrame, ref: str, at: str, key: str, start: str, end: str, most: int) -> list[tuple[str, DataFrame, DataFrame]]:
    """(path, references, lifetimes) of the heavy keys, whose lifetimes are broadcast, and of all others."""
    spark, asked = refs.sparkSession, asked_only(refs, ref, at)
    hot = F.broadcast(heavy_keys(asked, ref, at, most))
    theirs = lifetimes(nodes.join(hot, F.col(key) == F.col("_hot"), "left_semi"), key, start, end)
    found = theirs.join(hot, F.col("_key") == F.col("_hot"), "right").where(F.coalesce(F.size("_spans"), F.lit(0)) <= HEAVY_SPANS).select("_hot", "_key", "_first", "_spans")
    few = spark.createDataFrame(found.collect(), found.schema)  # at most most x HEAVY_SPANS lifetimes
    names = F.broadcast(few.select(F.col("_hot").alias("_h")))
    dense, rest = (asked.join(names, F.col(ref) == F.col("_h"), how) for how in ("left_semi", "left_anti"))
    return [("heavy", dense, few.where("_key IS NOT NULL").select("_key", "_first", "_spans")), ("light", rest, lifetimes(nodes, key, start, end))]


def _orphans(path: str, rows: DataFrame, life: DataFrame, ref: str, at: str, columns: list[str]) -> DataFrame:
    """Anti-join against the lifetimes that hold at the time, then the reason by the key's first day; the
    second join finds both sides where the first left them."""
    key, t = F.col(ref) == F.col("_key"), F.col(at)
    way = "broadcast" if path == "heavy" else "merge"
    each = life.select("_key", F.explode("_spans").alias("_s")).select("_key", F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"))
    gone = rows.join(each.hint(way), key & (F.col("_a") <= t) & (t < F.col("_b")), "left_anti")
    why = F.when(F.col("_first").isNull(), "missing").when(t < F.col("_first"), "late").otherwise("deleted")
    return gone.join(life.select("_key", "_first").hint(way), key, "left").select(*columns, why.alias("state"))


def orphan_references(refs: DataFrame, nodes: DataFrame, ref: str, at: str, key: str, start: str, end: str, most: int = HEAVY_KEYS) -> DataFrame:
    """The rows of ``refs`` whose key has no valid record at the time, plus ``state`` and ``path``.

    A reference is missing if its key occurs in no record, late if all records of it start
    after the reference, otherwise deleted. Null and empty references and references without
    a time are no cases. Keys are compared as exact strings. Other columns of refs are kept,
    but for own columns ``state`` and ``path``, which are replaced; repeated rows stay repeated.

    Skew-aware split: references are counted per key and month (combined before the
    shuffle). The ``most`` commonest keys are heavy: their references meet a broadcast of just
    these keys' lifetimes, which is bounded by most x HEAVY_SPANS lifetimes, whatever the size
    of the tables; a heavy key with more lifetimes than that stays with the others. All other
    keys, none of which can have more than one in ``most`` references, take a shuffle anti-join. Both
    parts are put together; ``path`` says which one a row came through.
    """
    refs = refs.drop("state", "path")
    out = None
    for path, rows, life in _split(refs, nodes, ref, at, key, start, end, most):
        part = _orphans(path, rows, life, ref, at, refs.columns).withColumn("path", F.lit(path))
        out = part if out is None else out.unionByName(part)
    return out


def orphan_counts(refs: DataFrame, nodes: DataFrame, by: list[str], ref: str, at: str, key: str, start: str, end: str, most: int = HEAVY_KEYS) -> DataFrame:
    """Report per ``by`` columns and month: references, and orphans by state.

    Same split; repeated rows of refs count once. Either branch counts its references and
    its orphans on its own, and only these counts, a row per group, are put together.
    Groups may be null. Same columns as asked: ``by, month, n_references, n_missing, n_deleted, n_late``.
    """
    refs = refs.drop("state")
    states = ("missing", "deleted", "late")
    groups = [*by, F.date_format(at, "yyyy-MM").alias("month")]
    count = F.count(F.lit(1))
    zero = [F.lit(0).cast("long").alias(f"n_{s}") for s in states]
    parts = None
    for path, rows, life in _split(refs, nodes, ref, at, key, start, end, most):
        # light rows go to their key's place once, for the repeats as for the joins; heavy ones are spread by all their values
        once = rows.repartition(ref).dropDuplicates() if path == "light" else rows.dropDuplicates()
        totals = once.groupBy(*groups).agg(count.alias("n_references")).select("*", *zero)
        bad = _orphans(path, once, life, ref, at, refs.columns).groupBy(*groups).agg(F.lit(0).cast("long").alias("n_references"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states])
        both = totals.unionByName(bad)
        parts = both if parts is None else parts.unionByName(both)
    return parts.groupBy(*by, "month").agg(*[F.sum(c).alias(c) for c in ("n_references", *[f"n_{s}" for s in states])])
