"""robots.txt and sitemaps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

RULES = T.ArrayType(T.StructType([T.StructField("agent", T.StringType()), T.StructField("allow", T.BooleanType()), T.StructField("path", T.StringType())]))


def parse_robots(body: str | None) -> list[tuple[str, bool | None, str]]:
    """(agent, allow, path) of every rule; a group without rules gives (agent, None, '')."""
    out, agents, ruled = [], [], False
    for line in (body or "").lstrip("﻿").splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if ruled:
                agents, ruled = [], False
            agents.append(value.lower())
            out.append((value.lower(), None, ""))
        elif key in ("allow", "disallow") and agents:
            ruled = True
            if value:
                out += [(a, key == "allow", value) for a in agents]
    return out


@F.arrow_udf(RULES)
def _parsed(bodies: pa.Array) -> pa.Array:
    names = [f.name for f in RULES.elementType]
    return pa.array([[dict(zip(names, r)) for r in parse_robots(b)] for b in bodies.to_pylist()], to_arrow_type(RULES))


def robots_rules(files: DataFrame, key: str = "origin", body: str = "body") -> DataFrame:
    """``key, agent, allow, path, regex``: the rules of robots files as rows."""
    rows = files.select(key, F.explode(_parsed(F.col(body))).alias("r")).select(key, "r.*")
    return rows.withColumn("regex", rule_regex(F.col("path")))


def rule_regex(path: Column) -> Column:
    """Anchored regex of a rule: * matches anything, a closing $ the end."""
    quoted = F.regexp_replace(path, "([.+?()\\[\\]{}|^\\\\])", "\\\\$1")
    body = F.regexp_replace(F.regexp_replace(quoted, "\\$$", ""), "\\$", "\\\\\\$")
    return F.concat(F.lit("^"), F.regexp_replace(body, "\\*", ".*"), F.when(path.endswith("$"), "$").otherwise(""))


def allowed(requests: DataFrame, rules: DataFrame, key: str = "origin") -> DataFrame:
    """Adds ``allowed`` and ``specificity`` to rows ``key, agent, path``.

    The groups whose agent is the longest prefix of the asked agent apply together (* is 0);
    the longest matching rule decides, allow wins ties, no rule allows. Requests meet only their
    own site's rules, and repeated requests are decided once.
    """
    asked = requests.select(key, F.lower("agent").alias("_a"), "path").distinct()
    r = rules.select(key, F.col("agent").alias("_g"), "allow", F.length("path").alias("_len"), "regex")
    j = asked.join(r, key).where((F.col("_g") == "*") | F.col("_a").startswith(F.col("_g"))).withColumn("_spec", F.when(F.col("_g") == "*", 0).otherwise(F.length("_g")))
    hit = F.when(F.col("allow").isNotNull() & F.expr("path RLIKE regex"), F.struct(F.col("_len"), F.col("allow")))
    g = j.groupBy(key, "_a", "path", "_spec").agg(F.max(hit).alias("_hit"))
    best = g.groupBy(key, "_a", "path").agg(F.max(F.struct("_spec", "_hit")).alias("b"))
    out = requests.withColumn("_a", F.lower("agent")).join(best, [key, "_a", "path"], "left")
    return out.select(*requests.columns, F.coalesce("b._hit.allow", F.lit(True)).alias("allowed"), F.coalesce("b._spec", F.lit(0)).alias("specificity"))


def agent_matrix(files: DataFrame, agents: DataFrame, key: str = "origin") -> DataFrame:
    """Per site and listed crawler: allowed at the root, and ALLOW, BLOCK or UNDECLARED."""
    sites = files.select(key).distinct()
    asked = sites.withColumn("_l", F.lit(1)).join(agents.select(F.col("token").alias("agent"), "provider", "role", F.lit(1).alias("_l")), "_l").select(key, "agent", "provider", "role", F.lit("/").alias("path"))
    d = allowed(asked, robots_rules(files, key), key)
    return d.select(key, "agent", "provider", "role", "allowed", F.when(F.col("specificity") == 0, "UNDECLARED").when(F.col("allowed"), "ALLOW").otherwise("BLOCK").alias("policy_intent"))


# Where a sitemap is looked for if robots.txt names none.
SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]


def sitemap_candidates(files: DataFrame, key: str = "origin", body: str = "body") -> DataFrame:
    """``key, loc``: the sitemaps that robots.txt names, else the usual places."""
    named = F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit("(?im)^\\s*sitemap\\s*:\\s*([^\\s#]+)"), F.lit(1)), F.trim)
    usual = F.array(*[F.concat(F.regexp_replace(key, "/+$", ""), F.lit(p)) for p in SITEMAPS])
    return files.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(F.when(F.size(named) > 0, named).otherwise(usual))).alias("loc"))


def unpacked(bodies: DataFrame, content: str = "content", name: str = "body") -> DataFrame:
    """Sitemap files as text: compressed ones are known by their first two bytes; what can't be read is null. Each file is one row, as read by binaryFile."""

    @F.arrow_udf("string")
    def text(data: pa.Array) -> pa.Array:
        return pa.array([_text(x) for x in data.to_pylist()], pa.string())

    return bodies.withColumn(name, text(content))


def _text(data: bytes | None) -> str | None:
    import gzip
    import zlib

    try:
        return None if data is None else (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8", "replace")
    except (OSError, EOFError, zlib.error):
        return None


def sitemap_urls(files: DataFrame, body: str = "body") -> DataFrame:
    """``kind, loc``: distinct locations of sitemaps (url) and sitemap indexes (sitemap)."""
    kind = F.when(F.lower(body).contains("<sitemapindex"), "sitemap").otherwise("url")
    locs = F.regexp_extract_all(body, F.lit("(?is)<loc[^>]*>\\s*(?:<!\\[CDATA\\[)?\\s*(.*?)\\s*(?:\\]\\]>)?\\s*</loc>"), F.lit(1))
    plain = F.col("loc")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return files.select(kind.alias("kind"), F.explode(locs).alias("loc")).select("kind", plain.alias("loc")).where("loc <> ''").distinct()


