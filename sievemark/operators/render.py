"""Rendered pages against the pages that the server sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..functions.urls import canonical_url, url_path


def matched(p: DataFrame, rendered: DataFrame) -> DataFrame:
    """Each rendered page with its page: the one of the same URL, else the first one of the same path.

    ``rendered`` has url, title, canonical, h1, json_ld_types; its columns come back as ``r_...``, the page's under their names.
    Pages meet by equal URL and by equal path, never all with all.
    """
    r = rendered.select(*[F.col(c).alias(f"r_{c}") for c in ("url", "title", "canonical", "h1", "json_ld_types")]).withColumns({"_ru": F.coalesce(canonical_url(F.col("r_url")), F.col("r_url")), "_rp": F.when(F.col("r_url").contains("://"), url_path(F.col("r_url"))).otherwise(F.col("r_url"))})
    cols = ["_url", "_path", "ordinal", "status", "indexability", "title", "canonical", "headings", "json_ld"]
    page = p.select(F.col("_url").alias("_key"), F.struct(*cols).alias("_same")).dropDuplicates(["_key"])
    first = p.groupBy(F.col("_path").alias("_place")).agg(F.min_by(F.struct(*cols), "ordinal").alias("_alike"))
    j = r.join(page, F.col("_ru") == F.col("_key"), "left").join(first, F.col("_rp") == F.col("_place"), "left")
    return j.withColumn("_p", F.coalesce("_same", "_alike")).select(*[f"r_{c}" for c in ("url", "title", "canonical", "h1", "json_ld_types")], "_p.*")


def _norm(c: Column) -> Column:
    return collapse(c)


def _path_of(c: Column) -> Column:
    return F.when(canonical_url(c).isNotNull(), url_path(c)).otherwise(c)


def reconcile(p: DataFrame, rendered: DataFrame) -> DataFrame:
    """RENDER-003 to 006: title, canonical, h1 or JSON-LD types that only the rendered page has; RENDER-007: rendered pages that weren't crawled.

    Null values of the rendered page are unmeasured; a page that is neither indexable nor answers 200 isn't compared. Canonicals agree by path too, and a page
    without one has its own path.
    """
    m = matched(p, rendered)
    known = F.col("_url").isNotNull()
    compared = known & ((F.col("indexability") == "indexable") | (F.col("status") == 200))
    h1 = F.try_element_at(F.filter("headings", lambda h: h["level"] == 1), F.lit(1))["text"]
    differs = lambda http, seen: seen.isNotNull() & (F.coalesce(_norm(http), F.lit("")) != _norm(seen))
    own, theirs = _norm(F.coalesce("canonical", F.col("_path"))), _norm(F.col("r_canonical"))
    agree = (F.coalesce(theirs, F.lit("")) == "") | ((own != "") & ((own == theirs) | (_path_of(own) == _path_of(theirs))))
    types = F.coalesce(F.flatten(F.transform("json_ld", lambda b: b["types"])), F.array().cast("array<string>"))
    case = lambda when, code, severity, subject: F.when(when, F.struct(F.lit(f"SE-RENDER-{code}").alias("code"), F.lit(severity).alias("severity"), subject.alias("subject")))
    url = F.col("r_url")
    tagged = lambda t: F.concat(url, F.lit(f":{t}"))
    single = F.filter(F.array(
        case(~known, "007", "info", url), case(compared & differs(F.col("title"), F.col("r_title")), "003", "warn", tagged("title")),
        case(compared & ~agree & differs(F.coalesce("canonical", F.col("_path")), F.col("r_canonical")), "004", "warn", tagged("canonical")), case(compared & differs(h1, F.col("r_h1")), "005", "warn", tagged("h1")),
    ), lambda x: x.isNotNull())
    extra = F.transform(F.array_except(F.coalesce("r_json_ld_types", F.array().cast("array<string>")), types), lambda t: case(F.lit(True), "006", "warn", F.concat(url, F.lit(":"), t)))
    hits = F.concat(single, F.when(compared, extra).otherwise(F.filter(extra, lambda x: F.lit(False))))
    return m.select(F.explode(hits).alias("h"), url.alias("url")).select("h.code", F.lit("RENDER").alias("family"), "h.severity", "url", "h.subject")


def layer_states(p: DataFrame, rendered: DataFrame) -> DataFrame:
    """``url, state`` of every rendered page: render_only, contradicted or expected."""
    bad = reconcile(p, rendered).groupBy("url").agg(F.bool_or(F.col("code") == "SE-RENDER-007").alias("_only"))
    state = F.when(F.col("_only").isNull(), "expected").when(F.col("_only"), "render_only").otherwise("contradicted")
    return rendered.select("url").distinct().join(bad, "url", "left").select("url", state.alias("state"))
