"""Reports written and read: findings as JSON, text and HTML; snapshots and baselines as compact files or whole reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "code string, fingerprint string, severity string, url string, summary string"
PAGE = "url string, status int, indexable string, content_hash string, title string"
_COMPACT = f"snapshot_id string, site string, mode string, pages array<struct<{PAGE.replace(' ', ':').replace(',:', ',')}>>, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>"
_REPORT = f"inventory struct<snapshot_id:string,site:string,mode:string,pages:array<struct<{PAGE.replace(' ', ':').replace(',:', ',')}>>>, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>"


def write_findings(findings: DataFrame, folder: str) -> None:
    """All findings as JSON lines, in as many files as there are partitions."""
    findings.write.mode("overwrite").json(folder)


def summary(findings: DataFrame) -> DataFrame:
    """``severity, code, n``: findings by severity and code, errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).orderBy(rank, "code")


def render_text(findings: DataFrame, most: int = 50) -> str:
    """Counts by code and the first ``most`` findings as text; the limit is the form's, all findings are in write_findings()."""
    lines = [f"{r['severity']:6} {r['code']:16} {r['n']}" for r in summary(findings).collect()]  # one row per code
    shown = findings.orderBy("severity", "code", "url").limit(most).collect()
    return "\n".join([*lines, "", *[f"{r['severity']} {r['code']} {r['url']}" for r in shown]])


def render_html(findings: DataFrame, most: int = 50) -> str:
    """The same as a page."""
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    counts = [row(r) for r in summary(findings).collect()]
    shown = [row((r["severity"], r["code"], r["url"])) for r in findings.orderBy("severity", "code", "url").limit(most).collect()]
    head = row(("severity", "code", "findings"), "th"), row(("severity", "code", "url"), "th")
    return f"<!doctype html><meta charset=utf-8><title>Findings</title><table>{head[0]}{''.join(counts)}</table><table>{head[1]}{''.join(shown)}</table>"


def load_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, findings), both with ``snapshot_id``, of JSON files that are either compact snapshots or whole
    reports (whose pages are under ``inventory``). Files of neither form give nothing."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\ufeff", "").alias("v"))
    both = text.select(F.from_json("v", _COMPACT).alias("c"), F.from_json("v", _REPORT).alias("r"))
    s = both.select(F.coalesce("c.snapshot_id", "r.inventory.snapshot_id").alias("snapshot_id"), F.coalesce("c.pages", "r.inventory.pages").alias("p"), F.coalesce("c.findings", "r.findings").alias("f")).where("snapshot_id IS NOT NULL")
    return s.select("snapshot_id", F.explode("p").alias("x")).select("snapshot_id", "x.*"), s.select("snapshot_id", F.explode("f").alias("x")).select("snapshot_id", "x.*")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``fingerprint, url`` of the errors that a baseline accepts: a compact list of fingerprints, or a report's errors."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\ufeff", "").alias("v"))
    listed = text.select(F.explode(F.from_json("v", "fingerprints array<string>")["fingerprints"]).alias("fingerprint")).select("fingerprint", F.lit(None).cast("string").alias("url"))
    _, findings = load_snapshots(spark, path)
    plain = text.select(F.explode(F.from_json("v", _COMPACT)["findings"]).alias("x")).select("x.*")
    return listed.unionByName(findings.drop("snapshot_id").unionByName(plain).where("severity = 'error' AND fingerprint IS NOT NULL").select("fingerprint", "url")).distinct()


def error_codes(findings: DataFrame, most: int = 16) -> DataFrame:
    """``snapshot_id, codes``: the first ``most`` distinct error codes of each snapshot by name, for an index of snapshots."""
    codes = findings.where("severity = 'error'").groupBy("snapshot_id").agg(F.collect_set("code").alias("c"))  # codes are a short list
    return codes.select("snapshot_id", F.slice(F.array_sort("c"), 1, most).alias("codes"))
