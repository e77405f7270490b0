"""Routes that a repository's files predict, and how they meet the pages that answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_of
from ..functions.urls import segments

# What names a structured-data producer, and names that are no page.
_JSON_LD = "(?i)(json-?_?ld|structured-?_?data|schema)"
_RESERVED = ["generateMetadata", "metadata", "generateStaticParams", "viewport", "revalidate"]


def _segment(s: Column) -> Column:
    return (
        F.when(s.rlike("^\\[\\[?\\.\\.\\..+\\]\\]?$"), F.concat(F.lit("*"), F.regexp_replace(F.regexp_replace(s, "^\\[+\\.\\.\\.", ""), "\\]+$", ""))).when(s.rlike("^\\[\\[?[^\\[\\]]+\\]\\]?$"), F.concat(F.lit(":"), F.regexp_replace(s, "[\\[\\]]", ""))).otherwise(s)
    )


def app_pattern(path: Column) -> Column:
    """Route of an App Router page file: groups, slots and intercepting segments are left out, [x] is :x, [...x] is *x;
    null for other files and private folders."""
    rest = F.regexp_extract(path, "^(?:.*?/)?app/(.*?)/?page\\.(?:tsx|ts|jsx|js|mdx)$", 1)
    kept = F.filter(F.split(rest, "/"), lambda s: (s != "") & ~s.startswith("@") & ~s.rlike("^\\(.*\\)$") & ~s.rlike("^\\(\\.{1,4}\\).+"))
    joined = F.concat(F.lit("/"), F.array_join(F.transform(kept, _segment), "/"))
    return F.when(path.rlike("^(?:.*/)?app/(?:.*/)?/?page\\.(?:tsx|ts|jsx|js|mdx)$") & ~F.exists(kept, lambda s: s.startswith("_")), joined)


def intercepting(path: Column) -> Column:
    """The segment that an App Router path intercepts, else null."""
    return F.nullif(F.regexp_extract(path, "/\\(\\.{1,4}\\)([^/]+)", 1), F.lit(""))


def file_pattern(path: Column) -> Column:
    """Route of a file under a pages folder (scripts, .vue, .astro, .md): index is its folder; null for other files, api routes,
    and files or folders that begin with _ or hold components or layouts."""
    rest = F.regexp_extract(path, "^(?:.*?/)?(?:app/)?pages/(.*)\\.(?:tsx|ts|jsx|js|mdx|vue|astro|md)$", 1)
    parts = F.filter(F.split(rest, "/"), lambda s: s != "")
    bad = F.exists(parts, lambda s: s.startswith("_") | s.isin("components", "layouts")) | rest.startswith("api/")
    return F.when((rest != "") & ~bad, F.concat(F.lit("/"), F.array_join(F.transform(F.filter(parts, lambda s: s != "index"), _segment), "/")))


def route_families(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """``pattern, owner, router, intercepting, has_metadata, has_static_params, json_ld, helpers``: the routes that page files predict.

    A pattern that several files predict keeps the first file by name. json_ld are declared names that speak of
    structured data, helpers (name, specifier) imports that speak of seo.
    """
    app, plain = app_pattern(F.col(path)), file_pattern(F.col(path))
    declared = F.regexp_extract_all(F.col(source), F.lit("(?m)^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?(?:function|const|let|class)\\s+([A-Za-z_$][\\w$]*)"), F.lit(1))
    imports = F.transform(F.regexp_extract_all(F.col(source), F.lit("(?m)^\\s*import\\s[^;\\n]*?from\\s*['\"][^'\"]+['\"]"), F.lit(0)), lambda t: F.struct(F.regexp_extract(t, "import\\s+\\{?\\s*([A-Za-z_$][\\w$]*)", 1).alias("name"), F.regexp_extract(t, "from\\s*['\"]([^'\"]+)['\"]", 1).alias("specifier")))
    f = files.select(
        F.coalesce(app, plain).alias("pattern"), F.col(path).alias("owner"), F.when(app.isNotNull(), "app").otherwise("pages").alias("router"), intercepting(F.col(path)).alias("intercepting"),
        F.exists(declared, lambda n: n.isin("generateMetadata", "metadata")).alias("has_metadata"), F.array_contains(declared, "generateStaticParams").alias("has_static_params"),
        F.filter(declared, lambda n: n.rlike(_JSON_LD) & ~n.isin(_RESERVED)).alias("json_ld"), F.filter(imports, lambda i: F.lower(i["specifier"]).contains("seo") | F.lower(i["name"]).contains("seo") | i["name"].rlike(_JSON_LD)).alias("helpers"),
    )
    first = f.where("pattern IS NOT NULL").groupBy("pattern").agg(F.min_by(F.struct(*[c for c in f.columns if c != "pattern"]), "owner").alias("_f"))
    return first.select("pattern", "_f.*")


def merge_surfaces(*families: DataFrame) -> DataFrame:
    """Families of several surfaces; a pattern that occurs again keeps its first surface."""
    out = None
    for i, f in enumerate(families):
        g = f.withColumn("_no", F.lit(i))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out.groupBy("pattern").agg(F.min_by(F.struct(*[c for c in out.columns if c != "pattern"]), "_no").alias("_f")).select("pattern", *[f"_f.{c}" for c in out.columns if c not in ("pattern", "_no")])


def _keys(parts: Column, literal) -> Column:
    """struct<n, at, word> of every literal segment of a path."""
    every = F.transform(parts, lambda s, i: F.when(literal(s), F.struct(F.size(parts).alias("n"), i.alias("at"), s.alias("word"))))
    return F.filter(every, lambda x: x.isNotNull())


def match_routes(urls: DataFrame, patterns: DataFrame, path: str = "path", pattern: str = "pattern") -> DataFrame:
    """``path, pattern`` of every match: :name is one segment, a *name tail takes the rest, /:locale may be absent, closing slashes don't count.

    Not all with all: a pattern is entered under its number of segments and its last literal one, a path under each
    of its segments; only those that meet there are compared. Patterns without a literal meet paths of their length; catch-alls meet by
    a literal whatever the length.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).distinct()
    local = F.col("pattern").startswith("/:locale")
    shapes = p.select("pattern", F.explode(F.when(local, F.array("pattern", F.regexp_replace("pattern", "^/:locale", ""))).otherwise(F.array("pattern"))).alias("_q")).withColumn("_s", segments(F.col("_q")))
    tail = F.coalesce(F.try_element_at("_s", F.lit(-1)).startswith("*"), F.lit(False))
    keys = _keys(F.col("_s"), lambda s: ~s.startswith(":") & ~s.startswith("*"))
    last = F.try_element_at(keys, F.lit(-1))
    shapes = shapes.select("pattern", "_s", tail.alias("_tail"), F.when(tail, -1).otherwise(F.size("_s")).alias("_n"), F.coalesce(last["at"], F.lit(-1)).alias("_at"), F.coalesce(last["word"], F.lit("")).alias("_word"))
    own = urls.select(F.col(path).alias("path")).distinct().withColumn("_p", segments(F.col("path")))
    n = F.size("_p")
    bare = F.array(F.struct(n.alias("n"), F.lit(-1).alias("at"), F.lit("").alias("word")), F.struct(F.lit(-1).alias("n"), F.lit(-1).alias("at"), F.lit("").alias("word")))
    words = _keys(F.col("_p"), lambda s: F.lit(True))
    each = own.select("path", "_p", F.explode(F.concat(words, F.transform(words, lambda w: F.struct(F.lit(-1).alias("n"), w["at"].alias("at"), w["word"].alias("word"))), bare)).alias("k"))
    j = each.join(shapes, (F.col("k.n") == F.col("_n")) & (F.col("k.at") == F.col("_at")) & (F.col("k.word") == F.col("_word")))
    head = F.when(F.col("_tail"), F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0)))).otherwise(F.col("_s"))
    fits = F.forall(F.arrays_zip(head.alias("a"), F.slice("_p", 1, F.size(head)).alias("b")), lambda z: z["b"].isNotNull() & (z["a"].startswith(":") | (z["a"] == z["b"])))
    return j.where((F.size("_p") >= F.size(head)) & fits).select("path", "pattern").distinct()


def _finding(df: DataFrame, code: str, severity: Column, url: Column, subject: Column) -> DataFrame:
    return df.select(F.lit(f"SE-{code}").alias("code"), F.lit(code.split("-")[0]).alias("family"), severity.alias("severity"), url.alias("url"), subject.alias("subject"))


def route_findings(p: DataFrame, families: DataFrame, allowed, has_sitemap: bool = True) -> DataFrame:
    """RENDER-001: allowed families without a page. RENDER-002: allowed pages with status 200 that no family
    predicts. SITEMAP-003: no sitemap module. PROG-001: families of towns or catch-alls, a warning without static parameters.

    ``allowed`` maps a pattern or path column to whether it may be indexed; families have pattern, owner, has_static_params.
    """
    met = match_routes(p.select(F.col("_path").alias("path")), families)
    info, warn = F.lit("info"), F.lit("warn")
    only_source = families.where(allowed(F.col("pattern"))).join(met.select("pattern").distinct(), "pattern", "left_anti")
    live = p.where("status = 200").where(allowed(F.col("_path")))
    only_live = live.join(met.select(F.col("path").alias("_path")).distinct(), "_path", "left_anti") if not families.isEmpty() else live.where("false")
    many = families.where(F.col("pattern").contains(":city") | F.col("pattern").contains("*"))
    out = _finding(only_source, "RENDER-001", info, F.col("owner"), F.col("pattern")).unionByName(_finding(only_live, "RENDER-002", info, F.col("_url"), F.col("_url")))
    out = out.unionByName(_finding(many, "PROG-001", F.when(F.col("has_static_params"), info).otherwise(warn), F.col("owner"), F.col("pattern")))
    if p.isEmpty():
        out = out.where("code = 'SE-PROG-001'")
    if not has_sitemap:
        out = out.unionByName(_finding(p.sparkSession.createDataFrame([("sitemap.ts",)], "f string"), "SITEMAP-003", warn, F.lit(""), F.col("f")))
    return out


def policy_finding(spark, error: str | None, repo: str = ".") -> DataFrame:
    """IDX-001 where the policy can't be read."""
    rows = [("SE-IDX-001", "IDX", "error", repo, repo)] if error else []
    return spark.createDataFrame(rows, "code string, family string, severity string, url string, subject string")


def faq_findings(p: DataFrame, producers: DataFrame) -> DataFrame:
    """AI-003: families with a faq producer that is no schema, without any page. ``producers`` is name, path, pattern."""
    hay = F.lower(F.concat_ws(" ", "name", "path"))
    tight = F.regexp_replace(hay, "[-_]", "")
    faq = producers.where(hay.contains("faq") & ~(tight.contains("schema") | tight.contains("jsonld") | tight.contains("structureddata")))
    met = match_routes(p.where("_html").select(F.col("_path").alias("path")), faq).select("pattern").distinct()
    lone = faq.join(met, "pattern", "left_anti").groupBy("pattern").agg(F.min("path").alias("path"))
    return _finding(lone, "AI-003", F.lit("warn"), F.col("path"), F.col("pattern"))


def config_of(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """``path, base_path, trailing_slash, redirects, rewrites`` of next.config files: only what is written as literals."""
    c = files.where(F.col(path).rlike("(^|/)next\\.config\\.[a-z]+$"))
    text = F.col(source)
    hop = "source:\\s*['\"]([^'\"]+)['\"][^}]*?destination:\\s*['\"]([^'\"]+)['\"]"

    def hops(section: str) -> Column:
        part = F.regexp_extract(text, f"(?s){section}\\b(.*?)(?:\\b(?:redirects|rewrites)\\b|$)", 1)
        return F.transform(F.regexp_extract_all(part, F.lit(f"(?s){hop}[^}}]*"), F.lit(0)), lambda h: F.struct(F.regexp_extract(h, hop, 1).alias("source"), F.regexp_extract(h, hop, 2).alias("destination"), h.rlike("permanent:\\s*true").alias("permanent")))

    literal = F.nullif(F.regexp_extract(text, "basePath:\\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))
    return c.select(F.col(path).alias("path"), literal.alias("base_path"), F.nullif(F.regexp_extract(text, "trailingSlash:\\s*(true|false)", 1), F.lit("")).cast("boolean").alias("trailing_slash"), hops("redirects").alias("redirects"), hops("rewrites").alias("rewrites"))


def aliases_of(tsconfig: str) -> list[tuple[str, str]]:
    """(alias, target) of the paths of a tsconfig file; comments are ignored."""
    import re

    plain = re.sub(r"//[^\n]*", "", tsconfig)
    block = re.search(r'"paths"\s*:\s*\{(.*?)\}', plain, re.S)
    return [(k, v.removeprefix("./")) for k, v in re.findall(r'"([^"]+)"\s*:\s*\[\s*"([^"]+)"', block.group(1) if block else "")]


def resolve_import(importer: Column, specifier: Column, aliases: list[tuple[str, str]]) -> Column:
    """The path that an import names: by aliases, by @/ and ~/ as src/, else relative to the importing file; null for packages."""
    out = F.lit(None).cast("string")
    relative = F.concat(F.regexp_replace(importer, "[^/]*$", ""), specifier)
    parts = F.filter(F.split(relative, "/"), lambda s: ~s.isin("", "."))
    climbed = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    out = F.when(specifier.startswith("."), F.array_join(climbed, "/")).when(specifier.rlike("^[@~]/"), F.concat(F.lit("src/"), F.substr(specifier, F.lit(3))))
    for alias, target in reversed(aliases):
        head, goal = alias.removesuffix("/*"), target.removesuffix("/*")
        hit = specifier.startswith(head + "/") if alias.endswith("/*") else specifier == alias
        out = F.when(hit, F.concat(F.lit(goal + "/"), F.substr(specifier, F.lit(len(head) + 2))) if alias.endswith("/*") else F.lit(target)).otherwise(out)
    return out


def imports_of(files: DataFrame, aliases: list[tuple[str, str]] = [], path: str = "path", source: str = "source") -> DataFrame:  # noqa: B006
    """``src, dst``: files and the files they import, types left out; a specifier without an ending finds .ts, .tsx, .js, .jsx and index files."""
    lines = F.regexp_extract_all(F.col(source), F.lit("(?m)^\\s*import\\s+(?!type\\b)[^;\\n]*?from\\s*['\"]([^'\"]+)['\"]"), F.lit(1))
    wanted = files.select(F.col(path).alias("src"), F.explode(lines).alias("_spec")).select("src", resolve_import(F.col("src"), F.col("_spec"), aliases).alias("_to")).where("_to IS NOT NULL")
    stem = F.regexp_replace(F.regexp_replace(F.col(path), "\\.(?:tsx?|jsx?)$", ""), "/index$", "")
    known = files.select(F.col(path).alias("dst"), stem.alias("_stem"))
    return wanted.withColumn("_stem", F.regexp_replace(F.regexp_replace("_to", "\\.(?:tsx?|jsx?)$", ""), "/index$", "")).join(known, "_stem").select("src", "dst").distinct()


def import_cone(producers: DataFrame, imports: DataFrame, depth: int = 4) -> DataFrame:
    """``path, pattern``: families of the files that produce them and of all that these import, up to ``depth`` imports away."""
    cone = producers.select("path", "pattern").distinct()
    front = cone
    for _ in range(depth):
        front = front.join(imports, front["path"] == imports["src"]).select(F.col("dst").alias("path"), "pattern").distinct()
        cone = cone.unionByName(front)
    return cone.distinct()


def producer_hashes(files: DataFrame, cone: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """``path, hash, patterns``: the 128-bit hash of each producing file and the families that it touches, in order."""
    own = files.select(F.col(path).alias("path"), hash_of(F.col(source)).alias("hash"))
    return cone.groupBy("path").agg(F.array_sort(F.collect_set("pattern")).alias("patterns")).join(own, "path").select("path", "hash", "patterns")


def impacted_urls(changes: DataFrame, hashes: DataFrame, urls: DataFrame) -> DataFrame:
    """``path, url_path``: pages of the families that changed sources touch. ``changes`` has ``path``."""
    touched = hashes.join(changes.select("path").distinct(), "path").select("path", F.explode("patterns").alias("pattern"))
    return touched.join(match_routes(urls, touched).withColumnRenamed("path", "url_path"), "pattern").select("path", "url_path").distinct()
