"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

BROADCAST_SNAPSHOTS = 200_000  # a table of snapshots of at most this many rows is sent to all tasks, a larger one is shuffled


def plain_hash(value: Column) -> Column:
    """One notation for a hash value: no algorithm or 0x prefix, lower case. Null stays null."""
    return F.regexp_replace(F.lower(F.trim(value)), "^(?:[a-z0-9-]+:|0x)", "")


def consecutive_snapshots(runs: DataFrame, delivered: DataFrame) -> DataFrame:
    """Pairs ``site, older, newer, recorded_at`` of neighbouring snapshots of a site.

    A site is the same with or without closing slashes. Snapshots that delivered no row
    (absent from ``delivered.snapshot_id``) are left out before pairing; repeated rows count
    once. Order is recorded_at, then snapshot_id. The first snapshot of a site has older null.
    Runs without site, snapshot id or time are left out.
    """
    known = runs.where("site IS NOT NULL AND snapshot_id IS NOT NULL AND recorded_at IS NOT NULL")
    once = known.groupBy(F.regexp_replace("site", "/+$", "").alias("site"), "snapshot_id").agg(F.min("recorded_at").alias("recorded_at"))
    filled = once.join(delivered.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    w = Window.partitionBy("site").orderBy("recorded_at", "snapshot_id")
    return filled.select("site", F.lag("snapshot_id").over(w).alias("older"), F.col("snapshot_id").alias("newer"), "recorded_at")


def snapshot_changes(records: DataFrame, pairs: DataFrame, key: str, value: Column | None = None) -> DataFrame:
    """Records ``snapshot_id, record_key, change`` added, removed or changed in each pair.

    ``records`` has ``snapshot_id``, ``key`` and the columns that ``value`` reads; without a
    value records can only be added or removed. snapshot_id is the newer one of the pair.

    Rows go once to the place of their site and key and only there take part in two pairs, as
    the newer and as the older side. Repeated rows of a snapshot count once; then every (pair,
    key, value) has a signed count, +1 for the newer side and -1 for the older one. What sums
    to 0 is identical and vanishes: EXCEPT ALL both ways, in one pass. The residues of both sides meet in a
    full join by key, at the same place: a key left on one side only is added or removed, unless an
    identical row of it vanished, then its set of values changed, as for a key left on both.
    A site with a third of all rows is spread by its keys. Null values equal each
    other; rows without a key or outside all pairs are left out.
    """
    v = F.lit(None).cast("string") if value is None else value
    rows = records.where(F.col(key).isNotNull()).select("snapshot_id", F.col(key).alias("record_key"), v.alias("_value"))
    # each snapshot once, with the pair that it ends and the pair that it begins
    roles = pairs.select("site", F.explode(F.array(F.struct(F.col("newer").alias("of"), F.when(F.col("older").isNotNull(), F.col("newer")).alias("ends"), F.lit(None).cast("string").alias("begins")), F.struct(F.col("older").alias("of"), F.lit(None).cast("string").alias("ends"), F.col("newer").alias("begins")))).alias("r"))
    roles = roles.where("r.of IS NOT NULL").groupBy("site", F.col("r.of").alias("_of")).agg(F.max("r.ends").alias("_ends"), F.max("r.begins").alias("_begins"))
    roles = cut_lineage(roles)
    roles = F.broadcast(roles) if roles.count() <= BROADCAST_SNAPSHOTS else roles
    placed = rows.join(roles, rows["snapshot_id"] == roles["_of"]).select("site", "record_key", "_value", "_ends", "_begins").repartition("site", "record_key")
    sides = F.array(F.struct(F.col("_ends").alias("pair"), F.lit(1).alias("sign")), F.struct(F.col("_begins").alias("pair"), F.lit(-1).alias("sign")))
    laid = placed.select("site", "record_key", "_value", F.explode(sides).alias("s")).select("site", "record_key", "_value", "s.*").where("pair IS NOT NULL")
    at = ["site", "record_key", "pair"]
    sums = laid.groupBy(*at, "_value").agg((F.max(F.greatest("sign", F.lit(0))) + F.min(F.least("sign", F.lit(0)))).alias("left"))
    some = lambda c: F.bool_or(c)
    keyed = sums.groupBy(*at).agg(some(F.col("left") > 0).alias("_plus"), some(F.col("left") < 0).alias("_minus"), some(F.col("left") == 0).alias("_same"))
    keyed = cut_lineage(keyed.where("_plus OR _minus"))  # only what differs
    new, old = keyed.where("_plus").select(*at, F.col("_same").alias("_n")), keyed.where("_minus").select(*at, F.col("_same").alias("_o"))
    met = new.join(old, at, "full")
    return met.select(
        F.col("pair").alias("snapshot_id"), "record_key",
        F.when(F.coalesce("_n", "_o") | (F.col("_n").isNotNull() & F.col("_o").isNotNull()), "changed").when(F.col("_o").isNull(), "added").otherwise("removed").alias("change"),
    )
