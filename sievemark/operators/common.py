"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: Column, tie: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order``.

    Nulls in ``order`` come last; equal orders are decided by ``tie`` (descending), so the
    result doesn't depend on the order in which rows arrive. Spark turns the row_number
    filter into a group limit before the shuffle, so repeated rows are thinned map-side.
    """
    w = Window.partitionBy(*keys).orderBy(order.desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def prefix_offsets(df: DataFrame, group: list[str], size: Column, spread: Column, buckets: int) -> DataFrame:
    """Adds ``_bucket`` and ``_base``: the sum of ``size`` over the group's earlier buckets.

    First half of a two-level running total: a group that holds a third of all rows is cut
    into ``buckets`` pieces by ``spread``, so no task has to sort a whole group. The second
    half is an ordinary window over (group, _bucket). The table of bucket sums has at most
    groups x buckets rows.
    """
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    sums = cut.groupBy(*group, "_bucket").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    on = [cut[g].eqNullSafe(base[g]) for g in group] + [cut["_bucket"] == base["_bucket"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = cut.join(base, cond, "left")
    for g in [*group, "_bucket"]:
        out = out.drop(base[g])
    return out


def ranked(df: DataFrame, order: list[Column], name: str = "rank", group: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rank of each row, 1 first, overall or within ``group``, without sorting everything, or a hot group, in one task.

    Rows are dealt by range to sorted partitions and numbered inside each; the numbers of
    earlier partitions, one row per partition and group in it, are added.
    """
    own = [F.col(c) for c in group]
    dealt = cut_lineage(df.repartitionByRange(*own, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group], "_base")
    on = F.col("_part") == F.col("_p")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    place = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    return dealt.withColumn("_row", place).join(base, on).select(*df.columns, (F.col("_row") + F.col("_base")).alias(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's spark.checkpoint.dir names it.

    Where the session names none, a temporary folder serves a session on one machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoints to the shared folder, so that a lost executor costs one step and not the whole chain."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
