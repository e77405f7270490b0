"""Graph operators over an edge table ``src, dst``. Every loop cuts its lineage by a checkpoint
in the shared folder, so a lost executor costs a step and not the whole loop."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

# Weight of a link by its place, factor of a template link, damping and rounds of the rank.
LOCATION_WEIGHTS = {"contextual": 1.0, "breadcrumb": 1.0, "header": 0.4, "nav": 0.3, "footer": 0.15}
TEMPLATE_FACTOR, TEMPLATE_MIN = 0.25, 3
DAMPING, ROUNDS = 0.85, 20


def _edges(edges: DataFrame, *more: str) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", *more)


def degrees(edges: DataFrame) -> DataFrame:
    """``node, outbound, inbound``; repeated edges count each time."""
    e = _edges(edges)
    return e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).groupBy("x.node").agg(F.sum("x.o").alias("outbound"), F.sum("x.i").alias("inbound"))


def template_frequency(edges: DataFrame, n_pages: int | Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Edges with ``template_frequency``: how often target and place meet among edges of equal
    ``within``, where that is at least three times and on half of the pages; else null, as where
    the number of pages is."""
    place = F.coalesce("location", F.lit("contextual"))
    # counted by group and joined back, so that the links to a home page are no single task
    counts = edges.groupBy(*[F.col(c).alias(f"_{c}") for c in (*within, "dst")], place.alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    on = place == F.col("_place")
    for c in (*within, "dst"):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = edges.join(counts, on, "left")
    tagged = F.when((F.col("_n") >= TEMPLATE_MIN) & (2 * F.col("_n") >= n_pages), F.col("_n"))
    return met.select(*edges.columns, tagged.alias("template_frequency"))


def link_weight(location: Column, template_frequency: Column) -> Column:
    """Weight of a link."""
    w = F.lit(LOCATION_WEIGHTS["contextual"])
    for name, v in LOCATION_WEIGHTS.items():
        w = F.when(location == name, v).otherwise(w)
    return w * F.when(template_frequency >= TEMPLATE_MIN, TEMPLATE_FACTOR).otherwise(1.0)


def depths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, depth``: fewest hops from any seed (column ``node``), however many.

    One frontier join and one anti join with the nodes seen so far per level; ends when a
    level finds nothing. Nodes that no seed reaches are absent.
    """
    e = _edges(edges).distinct()
    seen = cut_lineage(seeds.where("node IS NOT NULL").select("node", F.lit(0).alias("depth")).distinct())
    front = seen
    for level in count(1):
        found = e.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut_lineage(found.withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front)) if level % 4 == 0 else seen.unionByName(front)
    return seen


def page_rank(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``node, rank`` after exactly ``rounds`` rounds from a uniform start.

    Edges may have a ``weight`` (else 1); repeated edges add up; the rank of nodes without
    outgoing weight spreads over all nodes. Per round one join on the source and one
    aggregate by target; the sum over dangling nodes is one number on the driver.
    """
    e = _edges(edges, "weight") if "weight" in edges.columns else _edges(edges).withColumn("weight", F.lit(1.0))
    e = e.where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    shares = cut_lineage(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = _edges(edges).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    state = cut_lineage(nodes.join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    n = state.count()
    if not n:
        return state.select("node", F.lit(0.0).alias("rank"))
    state = state.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        loose = state.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
        got = shares.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        state = cut_lineage(state.drop("rank").join(got, "node", "left").select("node", "dangling", (F.lit((1 - DAMPING) / n + DAMPING * loose / n) + F.lit(DAMPING) * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return state.select("node", "rank")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of an undirected link table ``src, dst``; the smallest node names it.

    Each round a node takes the least label among its neighbours, then its label's label
    (which halves the distance to the root), until nothing changes: a number of rounds that
    grows with the logarithm of the longest path.
    """
    e = _edges(links).where("src <> dst")
    both = cut_lineage(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = cut_lineage(step.join(roots, "component", "left").select("node", "old", F.least("component", F.coalesce("root", F.col("component"))).alias("component")))
        changed = not jumped.where("old <> component").isEmpty()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
