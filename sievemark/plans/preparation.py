"""Queries of the general preparation problems (2 to 6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.days import named_day
from ..operators.common import cut_lineage, latest, table
from ..operators.drift import schema_changes, union_table
from ..operators.nested import flatten_nested
from ..operators.references import orphan_counts, orphan_references
from ..operators.rolling import build_trees, correct_trees, rolling_totals
from ..operators.snapshots import consecutive_snapshots, plain_hash, snapshot_changes

WINDOWS = [7, 30]
BRANCHES = ["rows", "keywords", "serp", "backlinks", "prompts"]
LISTS = {**{b: ["features"] for b in BRANCHES[:4]}, "prompts": ["cited_urls", "competitors"]}


# ---- 2: rolling totals
def _versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    return o.select("row_id", "loaded_at", "kind", "url", "period", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"))


def _daily(rows: DataFrame) -> DataFrame:
    return (
        rows.where("kind = 'search_performance' AND url IS NOT NULL").select("url", named_day(F.col("period")).alias("day"), "clicks", "impressions").where("day IS NOT NULL")
        .groupBy("url", "day").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    )


def _trees(spark: SparkSession, d: str) -> DataFrame:
    current = latest(_versions(spark, d), ["row_id"], F.col("loaded_at"), ["kind", "url", "period", "clicks", "impressions"])
    return build_trees(_daily(current), "url", "day", ["clicks", "impressions"])


def _shown(totals: DataFrame) -> DataFrame:
    return totals.select("url", "window_days", F.date_format("day", "yyyy-MM-dd").alias("day"), "clicks_total", "impressions_total", F.round("clicks_avg", 6).alias("clicks_avg"), F.round("impressions_avg", 6).alias("impressions_avg"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a url's trailing clicks fall to 0."""
    totals = rolling_totals(_trees(spark, d).select("url", "shard", "first_day", "last_day", "clicks"), "url", ["clicks"], WINDOWS)
    return totals.where("clicks_total = 0 AND clicks_prior > 0").select("url", "window_days", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p2_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages for every url, day and window."""
    return _shown(rolling_totals(_trees(spark, d), "url", ["clicks", "impressions"], WINDOWS))


def p2_late_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The same totals by another way: trees of the rows as first loaded, then corrected.

    A row's first version builds the trees; the difference to its latest version arrives as
    a late correction of the days that it leaves and enters.
    """
    cols = ["kind", "url", "period", "clicks", "impressions"]
    v = F.struct("loaded_at", *cols)
    ends = _versions(spark, d).groupBy("row_id").agg(F.min(v).alias("a"), F.max(v).alias("z"))
    first = _daily(ends.select("a.*"))
    moved = ends.where(~F.struct(*[F.col(f"a.{c}") for c in cols]).eqNullSafe(F.struct(*[F.col(f"z.{c}") for c in cols])))
    minus = moved.select("a.*").withColumns({m: -F.col(m) for m in ("clicks", "impressions")})
    changes = _daily(minus.unionByName(moved.select("z.*")))
    trees = correct_trees(cut_lineage(build_trees(first, "url", "day", ["clicks", "impressions"])), changes, "url", "day", ["clicks", "impressions"])
    return _shown(rolling_totals(trees, "url", ["clicks", "impressions"], WINDOWS))


# ---- 3: snapshots
def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return consecutive_snapshots(table(spark, d, "runs"), table(spark, d, "pages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages and findings added, removed or changed between consecutive snapshots."""
    pairs = _pairs(spark, d)
    pages = snapshot_changes(table(spark, d, "pages").select("snapshot_id", "url", "content_hash"), pairs, "url", plain_hash(F.col("content_hash")))
    findings = snapshot_changes(table(spark, d, "findings").select("snapshot_id", "fingerprint"), pairs, "fingerprint")
    cols = ["snapshot_id", "record_kind", "record_key", "change"]
    return pages.withColumn("record_kind", F.lit("page")).select(cols).unionByName(findings.withColumn("record_kind", F.lit("finding")).select(cols))


def p3_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes per snapshot and kind."""
    return p3_found(spark, d).groupBy("snapshot_id", "record_kind").agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "removed", "changed")])


# ---- 4: references
def _references(spark: SparkSession, d: str, kinds: bool = False) -> DataFrame:
    e = table(spark, d, "fact_edges")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("ref"), *([F.col(f"{s}_kind").alias("kind")] if kinds else [])) for s in ("source", "target")])
    return e.select("edge_id", "observed_at", F.explode(sides).alias("_s")).select("edge_id", "observed_at", "_s.*")


_NODES = ("ref", "observed_at", "id", "loaded_at", "deleted_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a valid node at the time of the edge."""
    return orphan_references(_references(spark, d), table(spark, d, "search_nodes"), *_NODES).select("edge_id", "side", "state").distinct()


def p4_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per side, kind and month; repeated edges count once."""
    return orphan_counts(_references(spark, d, True), table(spark, d, "search_nodes"), ["side", "kind"], *_NODES)


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Orphans that came through the broadcast of the heavy keys and through the shuffle of all others."""
    found = orphan_references(_references(spark, d), table(spark, d, "search_nodes"), *_NODES)
    return found.groupBy("path").agg(F.countDistinct("ref").alias("n_keys"), F.count(F.lit(1)).alias("n_orphans"))


# ---- 5: nested records
BROADCAST_FILES = 500_000  # a list of the files to read of at most this many rows is sent to all tasks, a longer one is shuffled


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each file; equal times are decided by the place of the row in its Parquet file.

    The deliveries are picked by their ids and places alone; then the nested records are read
    once, and only those picked are kept where they lie.
    """
    f = table(spark, d, "import_files").where("file_id IS NOT NULL")
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")]
    picked = latest(f.select("file_id", "delivered_at", *place), ["file_id"], F.col("delivered_at"), ["_path", "_row"]).select("_path", "_row")
    picked = cut_lineage(picked)
    picked = F.broadcast(picked) if picked.count() <= BROADCAST_FILES else picked
    return f.select("file_id", *BRANCHES, *place).join(picked, ["_path", "_row"], "left_semi").drop("_path", "_row")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every element and listed string of the latest files, by file and place."""
    return flatten_nested(_files(spark, d), "file_id", BRANCHES, LISTS, fields=False).select("file_id", "branch", "position", "sub_position")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of rows, keywords, serp and backlinks with their members as columns."""
    flat = flatten_nested(_files(spark, d), "file_id", BRANCHES[:4], {}, fields=True)
    text = ["query", "url", "provider", "kind", "period", "user_agent", "referer", "source_url"]
    whole = ["clicks", "impressions", "hits", "status", "volume", "search_volume", "difficulty", "keyword_difficulty", "referring_domains", "backlinks"]
    at = lambda n: F.try_element_at("fields", F.lit(n))
    return flat.select("file_id", "branch", "position", *[at(c).alias(c) for c in text], *[at(c).cast("long").alias(c) for c in whole], F.round(at("position").cast("float").cast("double"), 4).alias("rank_position"))


def p5_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of prompts."""
    flat = flatten_nested(_files(spark, d), "file_id", ["prompts"], {}, fields=True)
    at = lambda n: F.try_element_at("fields", F.lit(n))
    return flat.select("file_id", "position", *[at(c).alias(c) for c in ("prompt", "platform", "location", "language", "observed_at", "period")], at("brand_mentioned").cast("boolean").alias("brand_mentioned"), at("brand_position").cast("int").alias("brand_position"))


def p5_list_values(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of list strings, linked to their element by file, branch and position."""
    flat = flatten_nested(_files(spark, d), "file_id", BRANCHES, LISTS, fields=False)
    return flat.where("sub_position >= 0").select("file_id", "branch", "position", "sub_position", "value")


# ---- 6: drift
def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keyword_exports").drop("file_name")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Schema changes of each file against the one before it."""
    return schema_changes(_lines(spark, d)).select("file_id", "field", "new_field", "change")


def p6_change_log(spark: SparkSession, d: str) -> DataFrame:
    """The ordered log of changes with types and a running number per feed."""
    from pyspark.sql import Window

    w = Window.partitionBy("feed").orderBy("exported_at", "file_id", "change", "field")
    return schema_changes(_lines(spark, d)).withColumn("change_no", F.row_number().over(w)).select("feed", "change_no", "file_id", "exported_at", "change", "field", "new_field", "old_type", "new_type")


def p6_union_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable lines under the union schema."""
    return union_table(_lines(spark, d))


def p6_union_cells(spark: SparkSession, d: str) -> DataFrame:
    """The union table cell by cell: field, type of its column, and its value as number or text."""
    t = union_table(_lines(spark, d))
    cells = []
    for f in t.schema.fields:
        if f.name in ("feed", "file_id", "exported_at", "line_no"):
            continue
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        numeric = kind in ("long", "decimal", "double")
        cells.append(F.struct(F.lit(f.name).alias("field"), F.lit("number" if numeric else "text").alias("kind"), (c.cast("double") if numeric else F.lit(None).cast("double")).alias("number"), (F.lit(None).cast("string") if numeric else c.cast("string")).alias("text")))
    out = t.select("file_id", "line_no", F.explode(F.array(*cells)).alias("c")).select("file_id", "line_no", "c.*")
    return out.where("number IS NOT NULL OR text IS NOT NULL")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_rolling_totals, p2_late_corrections, p3_found, p3_change_counts, p4_found, p4_orphan_counts, p4_paths, p5_found, p5_records, p5_prompts, p5_list_values, p6_found, p6_change_log, p6_union_table, p6_union_cells)
}

# ---- SQL
_DAYS = r"""
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST, kind DESC NULLS LAST, url DESC NULLS LAST, period DESC NULLS LAST,
  coalesce(clicks, 0) DESC, coalesce(impressions, 0) DESC) AS rn FROM observations) WHERE rn = 1 AND kind = 'search_performance' AND url IS NOT NULL),
txt AS (SELECT url, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, period,
  regexp_extract(period, '^[^0-9]*([0-9]{4})[-/]?([0-9]{2})[-/]?([0-9]{2})([^0-9.].*)?$', ['y', 'm', 'd']) AS a,
  regexp_extract(period, '^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$', ['d', 'm', 'y']) AS b,
  regexp_extract(period, '^([0-9]{1,2}) ([A-Z][a-z]{2}) ([0-9]{4})$', ['d', 'm', 'y']) AS c,
  regexp_extract(period, '^([A-Z][a-z]{2}) ([0-9]{1,2}), ([0-9]{4})$', ['m', 'd', 'y']) AS e,
  regexp_extract(period, '^([0-9]{4})-([0-9]{3})$', ['y', 'n']) AS o FROM cur),
days AS (SELECT url, clicks, impressions, CASE
  WHEN a.y <> '' AND period NOT LIKE '%..%' THEN try_cast(a.y || '-' || a.m || '-' || a.d AS DATE)
  WHEN b.y <> '' THEN try_cast(b.y || '-' || b.m || '-' || b.d AS DATE)
  WHEN c.y <> '' THEN try_strptime(c.d || ' ' || c.m || ' ' || c.y, '%d %b %Y')::DATE
  WHEN e.y <> '' THEN try_strptime(e.d || ' ' || e.m || ' ' || e.y, '%d %b %Y')::DATE
  WHEN o.y <> '' THEN make_date(try_cast(o.y AS INT), 1, 1) + try_cast(o.n AS INT) - 1 END AS day FROM txt),
daily AS (SELECT url, day::DATE AS day, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions FROM days WHERE day IS NOT NULL GROUP BY ALL),
span AS (SELECT url, min(day) AS a, max(day) AS z FROM daily GROUP BY url),
grid AS (SELECT s.url, g.day::DATE AS day FROM span s, LATERAL (SELECT unnest(generate_series(s.a, s.z, INTERVAL 1 DAY)) AS day) g),
dense AS (SELECT g.url, g.day, coalesce(d.clicks, 0) AS clicks, coalesce(d.impressions, 0) AS impressions FROM grid g LEFT JOIN daily d USING (url, day)),
roll AS (SELECT url, day, w AS window_days, CASE w WHEN 7 THEN c7 ELSE c30 END AS clicks_total, CASE w WHEN 7 THEN i7 ELSE i30 END AS impressions_total FROM
  (SELECT url, day, sum(clicks) OVER w7 AS c7, sum(clicks) OVER w30 AS c30, sum(impressions) OVER w7 AS i7, sum(impressions) OVER w30 AS i30 FROM dense
   WINDOW w7 AS (PARTITION BY url ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY url ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  (SELECT unnest([7, 30])::INT AS w))
"""
_ROLL = f"""WITH {_DAYS} SELECT url, window_days, strftime(day, '%Y-%m-%d') AS day, clicks_total::BIGINT AS clicks_total, impressions_total::BIGINT AS impressions_total,
  round(clicks_total / window_days, 6) AS clicks_avg, round(impressions_total / window_days, 6) AS impressions_avg FROM roll"""
_CHANGES = """
filled AS (SELECT DISTINCT rtrim(r.site, '/') AS site, r.snapshot_id, r.recorded_at FROM runs r WHERE r.snapshot_id IN (SELECT snapshot_id FROM pages)),
pairs AS (SELECT snapshot_id AS newer, lag(snapshot_id) OVER (PARTITION BY site ORDER BY recorded_at, snapshot_id) AS older FROM filled),
rec AS (SELECT DISTINCT snapshot_id, 'page' AS record_kind, url AS record_key, regexp_replace(lower(trim(content_hash)), '^(?:[a-z0-9-]+:|0x)', '') AS v FROM pages
  UNION SELECT DISTINCT snapshot_id, 'finding', fingerprint, '' FROM findings),
newr AS (SELECT p.newer AS snapshot_id, record_kind, record_key, v FROM rec JOIN pairs p ON rec.snapshot_id = p.newer WHERE older IS NOT NULL),
oldr AS (SELECT p.newer AS snapshot_id, record_kind, record_key, v FROM rec JOIN pairs p ON rec.snapshot_id = p.older),
changes AS (SELECT snapshot_id, record_kind, record_key, 'added' AS change FROM newr n ANTI JOIN oldr o USING (snapshot_id, record_kind, record_key)
  UNION SELECT snapshot_id, record_kind, record_key, 'removed' FROM oldr ANTI JOIN newr USING (snapshot_id, record_kind, record_key)
  UNION SELECT n.snapshot_id, n.record_kind, n.record_key, 'changed' FROM newr n JOIN oldr o USING (snapshot_id, record_kind, record_key) WHERE n.v IS DISTINCT FROM o.v)
"""
_ORPHANS = """
refs AS (SELECT DISTINCT edge_id, observed_at, side, ref, kind FROM (
  SELECT edge_id, observed_at, 'source' AS side, source AS ref, source_kind AS kind FROM fact_edges UNION ALL SELECT edge_id, observed_at, 'target', target, target_kind FROM fact_edges)
  WHERE ref IS NOT NULL AND ref <> ''),
orphans AS (SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM search_nodes n WHERE n.id = r.ref) THEN 'missing'
  WHEN NOT EXISTS (SELECT 1 FROM search_nodes n WHERE n.id = r.ref AND n.loaded_at <= r.observed_at) THEN 'late' ELSE 'deleted' END AS state FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM search_nodes n WHERE n.id = r.ref AND n.loaded_at <= r.observed_at AND (n.deleted_at IS NULL OR n.deleted_at > r.observed_at)))
"""

_DRIFT = r"""
ok AS (SELECT feed, file_id, exported_at, delivered_at, line_no, body, try_cast(regexp_replace(trim(body), '^\x{FEFF}+', '') AS JSON) AS j FROM keyword_exports WHERE json_valid(regexp_replace(trim(body), '^\x{FEFF}+', '')) AND feed IS NOT NULL AND file_id IS NOT NULL),
ob AS (SELECT * FROM ok WHERE json_type(j) = 'OBJECT'),
val AS (SELECT feed, file_id, exported_at, json_extract_string(j, '$.query') AS query, field, json_type(j, '$."' || field || '"') AS t, json_extract_string(j, '$."' || field || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS field FROM ob)),
kin AS (SELECT *, CASE WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'decimal' WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END AS k FROM val WHERE t <> 'NULL'),
sch AS (SELECT feed, file_id, field, CASE WHEN count(DISTINCT k) = 1 THEN min(k) WHEN count(DISTINCT k) = 2 AND bool_and(k IN ('integer', 'decimal')) THEN 'decimal' ELSE 'string' END AS type, min(exported_at) AS exported_at FROM kin GROUP BY 1, 2, 3),
fil AS (SELECT feed, file_id, min(exported_at) AS exported_at FROM sch GROUP BY 1, 2),
ord AS (SELECT *, lag(file_id) OVER (PARTITION BY feed ORDER BY exported_at, file_id) AS before FROM fil),
nn AS (SELECT o.feed, o.file_id, s.field, s.type FROM ord o JOIN sch s ON s.feed = o.feed AND s.file_id = o.file_id WHERE o.before IS NOT NULL),
oo AS (SELECT o.feed, o.file_id, s.field, s.type FROM ord o JOIN sch s ON s.feed = o.feed AND s.file_id = o.before),
met AS (SELECT coalesce(n.feed, o.feed) AS feed, coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.field, o.field) AS field, n.type AS new_type, o.type AS old_type FROM nn n FULL JOIN oo o ON n.feed = o.feed AND n.file_id = o.file_id AND n.field = o.field),
pla AS (SELECT *, CASE WHEN k = 'object' THEN regexp_replace(v, '^\{"[^"]*":"?(.*?)"?\}$', '\1') WHEN k = 'array' THEN regexp_replace(v, '^\[|\]$|"', '', 'g') ELSE trim(v, ' ') END AS p FROM kin),
cmp AS (SELECT feed, file_id, query, field, min(coalesce(CASE WHEN regexp_full_match(p, '[-+]?[0-9][0-9,]*(\.[0-9]*)?([eE][-+]?[0-9]+)?') THEN try_cast(replace(p, ',', '') AS DOUBLE)::VARCHAR END, regexp_replace(p, '\s*[|,;]\s*', '|', 'g'))) AS v FROM pla WHERE query IS NOT NULL GROUP BY 1, 2, 3, 4),
same AS (SELECT g.feed, g.file_id, g.field AS gone, c.field AS came, g.old_type, c.new_type, avg((a.v = b.v)::INT) AS share FROM met g JOIN met c ON g.feed = c.feed AND g.file_id = c.file_id AND g.new_type IS NULL AND c.old_type IS NULL
  JOIN ord o ON o.feed = g.feed AND o.file_id = g.file_id JOIN cmp a ON a.feed = g.feed AND a.file_id = o.before AND a.field = g.field JOIN cmp b ON b.feed = g.feed AND b.file_id = g.file_id AND b.field = c.field AND b.query = a.query GROUP BY ALL HAVING avg((a.v = b.v)::INT) > 0.5),
ren AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed, file_id, gone ORDER BY share DESC, came) AS x, row_number() OVER (PARTITION BY feed, file_id, came ORDER BY share DESC, gone) AS y FROM same) WHERE x = 1 AND y = 1),
chg AS (SELECT feed, file_id, field, '' AS new_field, 'added' AS change, old_type, new_type FROM met m WHERE old_type IS NULL AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed = m.feed AND r.file_id = m.file_id AND r.came = m.field)
  UNION ALL SELECT feed, file_id, field, '', 'removed', old_type, new_type FROM met m WHERE new_type IS NULL AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed = m.feed AND r.file_id = m.file_id AND r.gone = m.field)
  UNION ALL SELECT feed, file_id, field, '', 'retyped', old_type, new_type FROM met WHERE old_type <> new_type
  UNION ALL SELECT feed, file_id, gone, came, 'renamed', old_type, new_type FROM ren UNION ALL SELECT feed, file_id, came, '', 'retyped', old_type, new_type FROM ren WHERE old_type <> new_type)
"""


def _branch_sql() -> str:
    parts = []
    for b in BRANCHES:
        parts.append(f"SELECT file_id, '{b}' AS branch, i AS position, -1 AS sub_position, NULL AS value FROM f, LATERAL (SELECT unnest(range(len({b}))) AS i) WHERE {b}[i + 1] IS NOT NULL")
        for s in LISTS[b]:
            parts.append(f"SELECT file_id, '{b}.{s}', i, j, {b}[i + 1].{s}[j + 1] FROM f, LATERAL (SELECT unnest(range(len({b}))) AS i), LATERAL (SELECT unnest(range(len({b}[i + 1].{s}))) AS j) WHERE {b}[i + 1].{s}[j + 1] IS NOT NULL")
    return " UNION ALL ".join(parts)


_FILES = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY delivered_at DESC) AS rn FROM import_files) WHERE rn = 1)"
_RECORDS = " UNION ALL ".join(f"SELECT file_id, '{b}' AS branch, i AS position, {b}[i + 1] AS r FROM f, LATERAL (SELECT unnest(range(len({b}))) AS i) WHERE {b}[i + 1] IS NOT NULL" for b in BRANCHES[:4])
_WHOLE = ["clicks", "impressions", "hits", "status", "volume", "search_volume", "difficulty", "keyword_difficulty", "referring_domains", "backlinks"]

SQL: dict[str, str] = {
    "p2_found": f"WITH {_DAYS} SELECT url, window_days, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, lag(clicks_total) OVER (PARTITION BY url, window_days ORDER BY day) AS prior FROM roll) WHERE clicks_total = 0 AND prior > 0",
    "p2_rolling_totals": _ROLL,
    "p3_found": f"WITH {_CHANGES} SELECT * FROM changes",
    "p3_change_counts": f"WITH {_CHANGES} SELECT snapshot_id, record_kind, count(*) FILTER (change = 'added') AS n_added, count(*) FILTER (change = 'removed') AS n_removed, count(*) FILTER (change = 'changed') AS n_changed FROM changes GROUP BY ALL",
    "p4_found": f"WITH {_ORPHANS} SELECT DISTINCT edge_id, side, state FROM orphans",
    "p4_orphan_counts": f"WITH {_ORPHANS} SELECT t.*, coalesce(o.n_missing, 0) AS n_missing, coalesce(o.n_deleted, 0) AS n_deleted, coalesce(o.n_late, 0) AS n_late FROM (SELECT side, kind, strftime(observed_at, '%Y-%m') AS month, count(*) AS n_references FROM refs GROUP BY ALL) t LEFT JOIN (SELECT side, kind, strftime(observed_at, '%Y-%m') AS month, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'deleted') AS n_deleted, count(*) FILTER (state = 'late') AS n_late FROM orphans GROUP BY ALL) o ON t.side = o.side AND t.kind IS NOT DISTINCT FROM o.kind AND t.month = o.month",
    "p4_paths": """WITH r AS (SELECT observed_at AS t, source AS ref FROM fact_edges UNION ALL SELECT observed_at, target FROM fact_edges), a AS (SELECT * FROM r WHERE ref IS NOT NULL AND ref <> '' AND t IS NOT NULL),
      h AS (SELECT ref FROM a GROUP BY ref HAVING count(*) > 1 ORDER BY count(*) DESC, ref LIMIT 1000),
      o AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM search_nodes n WHERE n.id = a.ref AND n.loaded_at <= a.t AND (n.deleted_at IS NULL OR n.deleted_at > a.t)))
      SELECT CASE WHEN ref IN (SELECT ref FROM h) THEN 'heavy' ELSE 'light' END AS path, count(DISTINCT ref) AS n_keys, count(*) AS n_orphans FROM o GROUP BY 1""",
    "p5_found": f"WITH {_FILES} SELECT file_id, branch, position::INT AS position, sub_position::INT AS sub_position FROM ({_branch_sql()})",
    "p5_list_values": f"WITH {_FILES} SELECT file_id, branch, position::INT AS position, sub_position::INT AS sub_position, value FROM ({_branch_sql()}) WHERE sub_position >= 0",
    "p5_records": f"WITH {_FILES} SELECT file_id, branch, position::INT AS position, r.query, r.url, r.provider, r.kind, r.period, r.user_agent, r.referer, r.source_url, {', '.join(f'r.{c}::BIGINT AS {c}' for c in _WHOLE)}, round(r.position::DOUBLE, 4) AS rank_position FROM ({_RECORDS})",
    "p5_prompts": f"WITH {_FILES} SELECT file_id, position::INT AS position, r.prompt, r.platform, r.location, r.language, r.observed_at, r.period, r.brand_mentioned, r.brand_position FROM (SELECT file_id, i AS position, prompts[i + 1] AS r FROM f, LATERAL (SELECT unnest(range(len(prompts))) AS i) WHERE prompts[i + 1] IS NOT NULL)",
}
SQL |= {
    "p6_found": f"WITH {_DRIFT} SELECT file_id, field, new_field, change FROM chg",
    "p6_change_log": f"WITH {_DRIFT} SELECT c.feed, row_number() OVER (PARTITION BY c.feed ORDER BY o.exported_at, c.file_id, change, field) AS change_no, c.file_id, o.exported_at, change, field, new_field, old_type, new_type FROM chg c JOIN ord o ON o.feed = c.feed AND o.file_id = c.file_id",
    "p6_union_cells": f"""WITH {_DRIFT}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed, file_id, line_no ORDER BY delivered_at DESC NULLS LAST, body DESC) AS rn FROM ob) WHERE rn = 1),
      typ AS (SELECT field, bool_and(type IN ('integer', 'decimal')) AS numeric FROM sch GROUP BY 1), cel AS (SELECT file_id, line_no, j, unnest(json_keys(j)) AS field FROM one),
      v AS (SELECT file_id, line_no, c.field, CASE WHEN numeric THEN 'number' ELSE 'text' END AS kind, json_type(j, '$."' || c.field || '"') AS t, json_extract_string(j, '$."' || c.field || '"') AS v FROM cel c JOIN typ USING (field))
      SELECT file_id, line_no, field, kind, CASE WHEN kind = 'number' THEN v::DOUBLE END AS number, CASE WHEN kind = 'text' THEN CASE WHEN t = 'DOUBLE' THEN regexp_replace(v, '\\.?0+$', '') ELSE v END END AS text FROM v WHERE t <> 'NULL'""",
}
SQL["p2_late_corrections"] = SQL["p2_rolling_totals"]
