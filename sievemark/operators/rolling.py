"""Rolling totals over trailing periods, answered from segment trees.

Every (entity, shard of 64 days) has one complete binary tree per measure, kept heap-ordered
in an array of 128 longs: node 1 is the whole shard, nodes 64..127 are its days. A trailing
total is read from O(log 64) nodes of the shard and of the shards before it that the window
reaches into. A late correction adds its difference to the seven nodes above one day and
leaves every other node alone, so stored trees needn't be rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = 64
STEP = 1 << 16  # days of one entity that are answered at a time
NODES = 2 * SPAN


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """Rows of a list column whose lists have NODES values; a null list gives zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((n, NODES), np.int64)
    there = np.asarray(column.is_valid())
    if there.any():
        out[there] = np.asarray(column.flatten()).reshape(-1, NODES)
    return out


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, NODES), pa.int32()), pa.array(m.reshape(-1)))


def add_leaves(tree: np.ndarray, row: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Adds values to days and to the nodes above them only. Changes and returns ``tree``."""
    node = slot + SPAN
    while node.size and node[0] >= 1:
        np.add.at(tree, (row, node), value)
        node = node >> 1
    return tree


def range_sum(tree: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of the days lo..hi (0..63, both included) of each row; 0 where hi < lo."""
    out = np.zeros(len(row), np.int64)
    left, right = lo + SPAN, hi + SPAN + 1
    empty = hi < lo
    left, right = np.where(empty, 1, left), np.where(empty, 1, right)
    while (left < right).any():
        take = (left < right) & (left & 1 == 1)
        out[take] += tree[row[take], left[take]]
        left = left + take
        take = (left < right) & (right & 1 == 1)
        right = right - take
        out[take] += tree[row[take], right[take]]
        left, right = left >> 1, right >> 1
    return out


def build_trees(daily: DataFrame, entity: str, day: str, measures: list[str]) -> DataFrame:
    """Trees of (entity, shard) from one row per entity and day.

    Gives ``entity, shard, first_day, last_day`` and one array of 128 longs per measure;
    first_day and last_day are the first and last day with a row. Null measures count as 0;
    rows without an entity or a day are left out. A shard has at most 64 days, so what one
    group collects is bounded.
    """
    keyed = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).withColumn("_d", F.unix_date(day))
    packed = keyed.groupBy(entity, F.floor(F.col("_d") / SPAN).cast("int").alias("shard")).agg(
        F.min("_d").alias("first_day"),
        F.max("_d").alias("last_day"),
        F.collect_list(F.struct(F.pmod("_d", F.lit(SPAN)).cast("int").alias("slot"), *[F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(m) for m in measures])).alias("leaves"),
    )
    schema = T.StructType([packed.schema[entity], *[T.StructField(c, T.IntegerType()) for c in ("shard", "first_day", "last_day")], *[T.StructField(m, T.ArrayType(T.LongType())) for m in measures]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = b.column("leaves")
            flat, row = leaves.flatten(), np.repeat(np.arange(b.num_rows), np.asarray(leaves.value_lengths()))
            slot = np.asarray(flat.field("slot")).astype(np.int64)
            trees = [_lists(add_leaves(np.zeros((b.num_rows, NODES), np.int64), row, slot, np.asarray(flat.field(m)))) for m in measures]
            yield pa.RecordBatch.from_arrays([b.column(entity), *[b.column(c).cast(pa.int32()) for c in ("shard", "first_day", "last_day")], *trees], names=[entity, "shard", "first_day", "last_day", *measures])

    return packed.mapInArrow(build, schema)


def corrected_shards(trees: DataFrame, changes: DataFrame, entity: str, day: str, measures: list[str]) -> DataFrame:
    """The shards that late corrections touch, corrected: what replaces them in stored trees.

    ``changes`` has one difference per entity and day (new minus old value) for each measure,
    several per day are allowed. Only the nodes above the changed days are touched; shards that did not exist begin empty. A day that is
    corrected down to 0 stays within first_day..last_day.
    """
    diffs = changes.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).withColumn("_d", F.unix_date(day))
    packed = diffs.groupBy(F.col(entity).alias("_e"), F.floor(F.col("_d") / SPAN).cast("int").alias("_s"), "_d").agg(*[F.sum(F.coalesce(F.col(m).cast("long"), F.lit(0))).alias(m) for m in measures])
    packed = packed.groupBy("_e", "_s").agg(F.min("_d").alias("_f"), F.max("_d").alias("_l"), F.collect_list(F.struct(F.pmod("_d", F.lit(SPAN)).cast("int").alias("slot"), *measures)).alias("leaves"))
    both = trees.join(packed, (trees[entity] == packed["_e"]) & (trees["shard"] == packed["_s"]), "right").select(
        packed["_e"].alias(entity), packed["_s"].alias("shard"), F.least("first_day", "_f").alias("first_day"), F.greatest("last_day", "_l").alias("last_day"), *[trees[m] for m in measures], "leaves"
    )
    schema = T.StructType([trees.schema[entity], *[T.StructField(c, T.IntegerType()) for c in ("shard", "first_day", "last_day")], *[T.StructField(m, T.ArrayType(T.LongType())) for m in measures]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = b.column("leaves")
            n = np.asarray(leaves.value_lengths().fill_null(0)).astype(np.int64)
            flat, row = leaves.flatten(), np.repeat(np.arange(b.num_rows), n)
            slot = np.asarray(flat.field("slot")).astype(np.int64)
            out = [_lists(add_leaves(_matrix(b.column(m), b.num_rows), row, slot, np.asarray(flat.field(m)))) for m in measures]
            yield pa.RecordBatch.from_arrays([b.column(entity), *[b.column(c).cast(pa.int32()) for c in ("shard", "first_day", "last_day")], *out], names=[entity, "shard", "first_day", "last_day", *measures])

    return both.mapInArrow(add, schema)


def correct_trees(trees: DataFrame, changes: DataFrame, entity: str, day: str, measures: list[str]) -> DataFrame:
    """Stored trees with late corrections: untouched shards as they are, which no Python sees, and corrected_shards()."""
    new = corrected_shards(trees, changes, entity, day, measures)
    dated = changes.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    touched = dated.select(F.col(entity).alias("_e"), F.floor(F.unix_date(day) / SPAN).cast("int").alias("_s")).distinct()
    return trees.join(touched, (trees[entity] == touched["_e"]) & (trees["shard"] == touched["_s"]), "left_anti").select(new.columns).unionByName(new)


def rolling_totals(trees: DataFrame, entity: str, measures: list[str], windows: list[int]) -> DataFrame:
    """Trailing totals of every entity for every day from its first to its last day with a row.

    Gives ``entity, day, window_days`` and for each measure ``<m>_total``, ``<m>_prior`` (the
    total as it stood the day before) and ``<m>_avg`` (total by days of the window). Days
    without rows are included; days before an entity's first day count as 0.

    Each shard's row gets the trees of the shards before it that the longest window reaches
    (one, for up to 64 days) by lag over (entity, shard): the shuffle is on the entity, and
    an entity has one row per 64 days however many rows it had.
    """
    reach = -(-max(windows) // SPAN)
    w = Window.partitionBy(entity).orderBy("shard")
    rows = trees.select(
        entity, "shard", "first_day", "last_day", *measures,
        F.lead("shard").over(w).alias("_next"),
        F.min("first_day").over(Window.partitionBy(entity)).alias("_from"),
        *[F.lag("shard", k).over(w).alias(f"_shard{k}") for k in range(1, reach + 1)],
        *[F.lag(m, k).over(w).alias(f"_{m}{k}") for k in range(1, reach + 1) for m in measures],
    )
    schema = T.StructType([trees.schema[entity], T.StructField("day", T.DateType()), T.StructField("window_days", T.IntegerType()), *[T.StructField(f"{m}_{k}", T.LongType()) for m in measures for k in ("total", "prior")]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # bounds the memory of one step
                b = whole.slice(at, 256)
                n = b.num_rows
                shard = np.asarray(b.column("shard")).astype(np.int64)
                nxt = np.asarray(b.column("_next").fill_null(-(2**30))).astype(np.int64)
                first = np.maximum(shard * SPAN, np.asarray(b.column("_from")).astype(np.int64))
                last = np.where(nxt > -(2**30), nxt * SPAN - 1, np.asarray(b.column("last_day")).astype(np.int64))
                many = last - first + 1
                levels = [(shard, {m: _matrix(b.column(m), n) for m in measures})]
                for k in range(1, reach + 1):
                    s = np.asarray(b.column(f"_shard{k}").fill_null(-(2**20))).astype(np.int64)
                    levels.append((s, {m: _matrix(b.column(f"_{m}{k}"), n) for m in measures}))

                def total(m: str, row: np.ndarray, day: np.ndarray, days: int) -> np.ndarray:
                    out = np.zeros(len(day), np.int64)
                    for s, t in levels:
                        base = s[row] * SPAN
                        out += range_sum(t[m], row, np.clip(day - days + 1 - base, 0, SPAN), np.clip(day - base, -1, SPAN - 1))
                    return out

                # a wrong year makes millions of days: pieces of at most STEP days, some of them at a time
                pieces = -(-many // STEP)
                owner = np.repeat(np.arange(n), pieces)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin, size = first[owner] + nth * STEP, np.minimum(many[owner] - nth * STEP, STEP)
                cuts = [*np.flatnonzero(np.diff(np.cumsum(size) // (4 * STEP), prepend=-1)).tolist(), len(size)]
                for i, j in zip(cuts[:-1], cuts[1:]):
                    length = size[i:j]
                    row = np.repeat(owner[i:j], length)
                    day = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin[i:j], length)
                    for days in windows:
                        columns = [x for m in measures for x in (total(m, row, day, days), total(m, row, day - 1, days))]
                        yield pa.RecordBatch.from_arrays(
                            [b.column(entity).take(pa.array(row)), pa.array(day.astype(np.int32)).cast(pa.date32()), pa.array(np.full(len(day), days, np.int32)), *map(pa.array, columns)],
                            names=[entity, "day", "window_days", *[f"{m}_{k}" for m in measures for k in ("total", "prior")]],
                        )

    out = rows.mapInArrow(answer, schema)
    return out.withColumns({f"{m}_avg": F.col(f"{m}_total") / F.col("window_days") for m in measures})
