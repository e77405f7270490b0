"""Runs over time: neighbouring and windowed runs, deltas, diffs and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import percent_delta
from ..functions.urls import without_slashes

# Seconds of a day, days of the window and its slack.
DAY = 86_400
WINDOW_DAYS, SLACK_DAYS = 28, 10


# Axes and the family of findings that each counts.
AXES = {
    "technical_discoverability": "CRAWL", "indexability": "IDX", "canonical_integrity": "CANON", "architecture": "LINK", "content_coverage": "CONTENT", "claim_integrity": "CLAIM", "market_integrity": "MARKET", "entity_integrity": "ENTITY", "local_seo": "LOCAL", "international": "I18N",
    "accessibility": "A11Y", "security": "SEC", "performance": "PERF", "programmatic_safety": "PROG", "observed_search": "OBS", "ai_retrieval_readiness": "AI", "render_reconciliation": "RENDER", "ai_visibility": "",
}


def axis_scores(findings: DataFrame, http: bool = True, source: bool = True, observed: bool = True, rendered: bool = True, cited: bool = True) -> DataFrame:
    """``axis, errors, warnings, infos, unmeasured``: all 18 axes, with findings (family, severity error, warn or info) or not.

    An axis without findings is unmeasured if what it rests on wasn't there; the visibility in answers counts no findings.
    """
    spark = findings.sparkSession
    missing = {"observed_search": not observed, "ai_retrieval_readiness": not http and not source, "programmatic_safety": not source, "accessibility": not http, "security": not http, "performance": not http}
    rows = spark.createDataFrame([(a, f, missing.get(a, False)) for a, f in AXES.items()], "axis string, family string, _missing boolean")
    n = findings.groupBy("family").agg(*[F.count_if(F.col("severity") == s).alias(c) for s, c in (("error", "errors"), ("warn", "warnings"), ("info", "infos"))])
    j = F.broadcast(rows).join(n, "family", "left")
    none = F.col("errors").isNull()
    unmeasured = F.when(F.col("axis") == "ai_visibility", F.lit(not cited)).when(F.col("axis") == "render_reconciliation", F.lit(not rendered)).otherwise(none & F.col("_missing"))
    return j.select("axis", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings", "infos")], unmeasured.alias("unmeasured"))


def comparable(a: Column, b: Column) -> Column:
    """Whether two runs (structs of origin, mode, version, rules and config) can be compared: equal in all, where a blank or null
    matches anything and a site counts as a hybrid."""
    plain = lambda c, n: F.nullif(F.trim(F.when(c["mode"] == "site", "hybrid").otherwise(c["mode"]) if n == "mode" else c[n]), F.lit(""))
    out = F.lit(True)
    for n in ("origin", "mode", "version", "rules", "config"):
        out = out & F.coalesce(plain(a, n) == plain(b, n), F.lit(True))
    return out


def filled_runs(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Each snapshot once, with its site (without closing slashes), for snapshots that have pages."""
    once = runs.where("site IS NOT NULL AND snapshot_id IS NOT NULL AND recorded_at IS NOT NULL").groupBy(without_slashes(F.col("site")).alias("site"), "snapshot_id").agg(
        F.min("recorded_at").alias("recorded_at"), F.max("repo_revision").alias("repo_revision"), F.max("mode").alias("mode"), F.max("errors").alias("errors")
    )
    return once.join(pages.select("snapshot_id").distinct(), "snapshot_id", "left_semi")


def reference_runs(filled: DataFrame) -> DataFrame:
    """Per site its latest run, the run before it, and the run nearest to 28 days earlier.

    The windowed run lies within 10 days of the target and isn't the latest; equal distances
    go to the greater id. An as-of join as one ranking per site: a site has few runs.
    """
    by_site = Window.partitionBy("site")
    rank = F.row_number().over(by_site.orderBy(F.desc("recorded_at"), F.desc("snapshot_id")))
    r = filled.withColumn("_k", rank).withColumn("_last", F.max("recorded_at").over(by_site))
    away = F.abs(F.col("recorded_at") - (F.col("_last") - WINDOW_DAYS * DAY))
    near = (F.col("_k") > 1) & (away <= SLACK_DAYS * DAY)
    r = r.withColumn("_w", F.when(near, F.row_number().over(Window.partitionBy("site", near).orderBy(away, F.desc("snapshot_id")))))
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    latest, before, window = F.col("_k") == 1, F.col("_k") == 2, F.col("_w") == 1
    return r.groupBy("site").agg(
        pick(latest, "snapshot_id").alias("latest"), pick(before, "snapshot_id").alias("previous"), pick(window, "snapshot_id").alias("window_run"),
        pick(latest, "repo_revision").alias("revision"), pick(before, "repo_revision").alias("previous_revision"), pick(latest, "mode").alias("mode"), pick(before, "mode").alias("previous_mode"),
        pick(latest, "errors").alias("errors"), pick(before, "errors").alias("previous_errors"),
    )


def _one(pages: DataFrame) -> DataFrame:
    return pages.where("url IS NOT NULL").groupBy("snapshot_id", "url").agg(F.max("gsc_clicks").alias("gsc_clicks"), F.max("producer_hash").alias("producer_hash"), F.max("content_hash").alias("content_hash"), F.max("citations").alias("citations"), F.max("status").alias("status"))


def page_history(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Pages of the latest run with what changed against the previous and the windowed run."""
    one = _one(pages)
    role = refs.select("site", F.explode(F.array(*[F.struct(F.lit(n).alias("role"), F.col(c).alias("snapshot_id")) for n, c in (("now", "latest"), ("before", "previous"), ("window", "window_run"))])).alias("r")).select("site", "r.*").where("snapshot_id IS NOT NULL")
    at = lambda n, c: F.max(F.when(F.col("role") == n, F.col(c)))
    # all three versions of a page meet by (site, url) in one aggregate instead of two joins
    g = one.join(role, "snapshot_id").groupBy("site", "url").agg(
        F.bool_or(F.col("role") == "now").alias("_in"), at("now", "gsc_clicks").alias("clicks"), at("before", "gsc_clicks").alias("_cb"), at("window", "gsc_clicks").alias("_cw"),
        at("now", "producer_hash").alias("_p"), at("before", "producer_hash").alias("_pb"), at("now", "citations").alias("citations"),
    )
    return g.where("_in").select("site", "url", "clicks", percent_delta(F.col("clicks"), F.col("_cb")).alias("clicks_delta"), percent_delta(F.col("clicks"), F.col("_cw")).alias("clicks_delta_28d"), (F.col("_p") != F.col("_pb")).alias("producer_changed"), "citations")


def gate(findings: DataFrame, pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Verdict per site of the latest run against the one before it.

    code 1 (errors) or 0 without a baseline; 11 if the runs aren't comparable (modes differ; a
    null mode matches any, site equals hybrid); 10 with new errors or lost coverage; else 0.
    An error that is gone counts as resolved only if its URL is still measured.
    """
    errors = findings.where("severity = 'error' AND fingerprint IS NOT NULL").groupBy("snapshot_id", "fingerprint").agg(F.min("url").alias("url"))
    sides = refs.select("site", F.explode(F.array(F.struct(F.col("latest").alias("snapshot_id"), F.lit(True).alias("head")), F.struct(F.col("previous").alias("snapshot_id"), F.lit(False).alias("head")))).alias("x")).select("site", "x.*").where("snapshot_id IS NOT NULL")
    met = errors.join(sides, "snapshot_id").groupBy("site", "fingerprint").agg(F.bool_or("head").alias("_head"), F.bool_or(~F.col("head")).alias("_base"), F.min("url").alias("url"))
    measured = pages.join(refs.select("site", F.col("latest").alias("snapshot_id")), "snapshot_id").select("site", "url", F.lit(True).alias("_m")).distinct()
    m = met.join(measured, ["site", "url"], "left")
    counts = m.groupBy("site").agg(
        F.count_if("_head").alias("n_errors"), F.count_if(F.col("_head") & ~F.col("_base")).alias("n_new"), F.count_if(~F.col("_head") & F.col("_m").isNotNull()).alias("n_resolved"), F.count_if(~F.col("_head") & F.col("_m").isNull()).alias("n_lost")
    )
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_errors", "n_new", "n_resolved", "n_lost")}
    side = lambda mode: F.struct(F.col("site").alias("origin"), F.col(mode).alias("mode"), *[F.lit("").alias(n) for n in ("version", "rules", "config")])
    base = F.col("previous").isNotNull()
    code = F.when(~base & (n["n_errors"] > 0), 1).when(~base, 0).when(~comparable(side("mode"), side("previous_mode")), 11).when((n["n_new"] > 0) | (n["n_lost"] > 0), 10).otherwise(0)
    return refs.join(counts, "site", "left").select("site", code.alias("code"), *[F.when(base | (F.lit(k) == "n_errors"), v).alias(k) for k, v in n.items()])
