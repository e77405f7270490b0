"""Markets, entities and claims of pages, judged by packs that the caller gives as data.

A pack owns a market: entities (what its pages may name), claims (phrases that need a fact) and
facts (how sources write that the fact is false). Pages are those of rules.with_state(). Packs are short lists
written by hand, so they travel inside the expressions; nothing is joined but pages with pages' groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, compact, contains_hebrew, contains_token

# Types that name a place, those that a town page may be bound by, and what binds them to a geography.
PLACE_TYPES = ["place", "city", "localbusiness", "service", "offer", "aggregateoffer", "professionalservice", "homeandconstructionbusiness"]
LOCAL_TYPES = ["place", "city", "localbusiness", "service", "professionalservice", "homeandconstructionbusiness"]
GEO_MARKERS = ["areaserved", "addresslocality", "addressregion", "postaladdress", "postalcode", '"geo"', "latitude", "longitude"]


@dataclass(frozen=True)
class Claim:
    """Phrases that say something a fact must support."""

    id: str
    phrases: tuple[str, ...]
    requires: str


@dataclass(frozen=True)
class Pack:
    """What one market owns."""

    id: str
    market: str
    markers: tuple[str, ...] = ()
    entities: tuple[tuple[str, str], ...] = ()  # token, label
    claims: tuple[Claim, ...] = ()
    facts: tuple[tuple[str, tuple[str, ...]], ...] = ()  # field, compact texts that mean false


@dataclass(frozen=True)
class Signals:
    """How a page's market shows: (market, ends of hosts), (market, languages), (market, parts of
    paths), (market, parts of the text), tried in this order; the first hit of a list counts."""

    hosts: tuple[tuple[str, str], ...] = ()
    languages: tuple[tuple[str, str], ...] = ()
    paths: tuple[tuple[str, str], ...] = ()
    texts: tuple[tuple[str, str], ...] = field(default_factory=tuple)


def visible_copy(p: DataFrame) -> Column:
    """Title, headings and text."""
    return F.concat_ws(" ", F.col("title"), F.array_join(F.transform("headings", lambda h: h["text"]), " "), F.col("text"))


def schema_copy() -> Column:
    """The raw JSON-LD of a page."""
    return F.coalesce(F.array_join(F.transform("json_ld", lambda b: b["raw"]), " "), F.lit(""))


def infer_market(signals: Signals, host: Column, lang: Column, path: Column, text: Column) -> Column:
    """The market of a page by host, language, path and text; null if none shows."""
    low, out = ascii_lower(text), None
    tests = [(m, host.endswith(x)) for m, x in signals.hosts] + [(m, F.lower(lang) == x.lower()) for m, x in signals.languages] + [(m, path.contains(x)) for m, x in signals.paths] + [(m, low.contains(x.lower())) for m, x in signals.texts]
    for market, test in tests:
        out = F.when(F.coalesce(test, F.lit(False)), market) if out is None else out.when(F.coalesce(test, F.lit(False)), market)
    return F.lit(None).cast("string") if out is None else out


def with_market(p: DataFrame, signals: Signals) -> DataFrame:
    """Adds ``_copy`` (visible and schema text) and ``_market``."""
    q = p.withColumn("_copy", F.concat_ws(" ", visible_copy(p), schema_copy()))
    return q.withColumn("_market", infer_market(signals, F.col("_host"), F.col("html_lang"), F.col("_path"), F.col("_copy")))


def _labels(tests: list[tuple[str, Column]]) -> Column:
    """Labels whose test holds, each once, in order."""
    if not tests:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(t, F.lit(label)) for label, t in tests]), lambda x: x.isNotNull())))


def _out(df: DataFrame, code: str, severity: str, subject: Column, url: str = "_url") -> DataFrame:
    return df.select(F.lit(f"SE-{code}").alias("code"), F.lit(code.split("-")[0]).alias("family"), F.lit(severity).alias("severity"), F.col(url).alias("url"), subject.alias("subject"))


def _of_market(packs: list[Pack], value) -> Column:
    """A value per pack, chosen by the page's market; null where no pack owns it."""
    out = F.when(F.lit(False), value(packs[0]))
    for p in packs:
        out = out.when(F.col("_market") == p.market, value(p))
    return out


def foreign_labels(packs: list[Pack], text: Column, hebrew_is_foreign: tuple[str, ...] = ()) -> Column:
    """Labels of entities of other markets that a text names; Hebrew script counts as one in the markets named."""
    def of(own: Pack) -> Column:
        tests = [(label, contains_token(text, token)) for p in packs if p.id != own.id for token, label in p.entities]
        return _labels(tests + ([("Hebrew script", contains_hebrew(text))] if own.market in hebrew_is_foreign else []))

    return _of_market(packs, of)


def market_findings(p: DataFrame, packs: list[Pack], signals: Signals, hebrew_is_foreign: tuple[str, ...] = ()) -> DataFrame:
    """MARKET-001: pages that name entities of another market; the subject lists them."""
    q = with_market(p.where("status < 400"), signals).withColumn("_hits", foreign_labels(packs, F.col("_copy"), hebrew_is_foreign)).where(F.size("_hits") > 0)
    return _out(q, "MARKET-001", "error", F.array_join("_hits", ","))


def page_claims(p: DataFrame, packs: list[Pack], signals: Signals) -> DataFrame:
    """``url, claim, pack, requires``: claims of pages below status 400, by phrases without white space."""
    q = with_market(p.where("status < 400"), signals).withColumn("_tight", compact(F.col("_copy")))
    each = lambda pack: F.array(*[F.when(F.lit(False), F.lit(None)), *[F.when(_any(c.phrases), F.struct(F.lit(c.id).alias("claim"), F.lit(pack.id).alias("pack"), F.lit(c.requires).alias("requires"))) for c in pack.claims]]) if pack.claims else F.array()

    def _any(phrases: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for x in phrases:
            hit = hit | F.col("_tight").contains("".join(x.split()).lower())
        return hit

    kind = "array<struct<claim:string,pack:string,requires:string>>"
    hits = F.filter(_of_market(packs, lambda pack: each(pack).cast(kind)), lambda x: x.isNotNull())
    return q.select(F.col("_url").alias("url"), F.explode(hits).alias("c")).select("url", "c.*")


def false_facts(files: DataFrame, packs: list[Pack], path: str = "path", source: str = "source") -> DataFrame:
    """``pack, field, path, line``: the first line of each file that says a fact of the pack is false.

    A file belongs to the packs whose markers its path or text holds; one without any to the packs
    whose first fact it names.
    """
    hay = ascii_lower(F.concat_ws("\n", F.col(path), F.col(source)))
    marked = {p.id: (_contains_any(hay, p.markers)) for p in packs}
    none = F.lit(True)
    for m in marked.values():
        none = none & ~m
    rows = []
    for p in packs:
        named = none & F.col(source).contains(p.facts[0][0]) if p.facts else F.lit(False)
        for name, literals in p.facts:
            rows.append(F.when(marked[p.id] | named, F.struct(F.lit(p.id).alias("pack"), F.lit(name).alias("field"), F.array(*map(F.lit, literals)).alias("literals"))))
    if not rows:
        rows = [F.lit(None).cast("struct<pack:string,field:string,literals:array<string>>")]
    lines = F.split(source, "\n")
    said = files.select(path, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r"), F.transform(lines, compact).alias("_lines"))
    at = F.transform("_lines", lambda t: F.exists("r.literals", lambda x: F.instr(t, x) > 0))
    return said.select("r.pack", "r.field", F.col(path).alias("path"), F.array_position(at, F.lit(True)).cast("int").alias("line")).where("line > 0")


def _contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for x in needles:
        hit = hit | text.contains(x.lower())
    return F.coalesce(hit, F.lit(False))


def claim_findings(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """CLAIM-001: claims of pages whose pack's sources say that a fact is false; the subject is the claim."""
    false = facts.select("pack").distinct()
    return _out(claims.join(false, "pack", "left_semi").withColumn("_url", F.col("url")), "CLAIM-001", "error", F.col("claim"))


def source_entities(files: DataFrame, packs: list[Pack], path: str = "path", source: str = "source") -> DataFrame:
    """MARKET-001 in sources: files of one pack that name entities of another."""
    parts = None
    for p in packs:
        own = files.where(_contains_any(ascii_lower(F.concat_ws("\n", F.col(path), F.col(source))), p.markers)).where(~F.col(path).rlike("\\.md$"))
        tests = [(label, contains_token(F.col(source), token)) for o in packs if o.id != p.id for token, label in o.entities]
        found = _out(own.withColumn("_hits", _labels(tests)).where(F.size("_hits") > 0), "MARKET-001", "error", F.concat(F.lit(p.id + ": "), F.array_join("_hits", ",")), path)
        parts = found if parts is None else parts.unionByName(found)
    return parts


def entity_findings(p: DataFrame, packs: list[Pack], signals: Signals) -> DataFrame:
    """ENTITY-001: entities of its own market that a page names but its JSON-LD does not.

    A label that at least half of a host's pages lack (of three or more) is the host's, in one finding for
    all such labels; other labels are the page's. Labels are counted per host and met again, so a host is no single task.
    """
    q = with_market(p.where("_html"), signals).withColumns({"_seen": visible_copy(p), "_declared": schema_copy()})
    missing = _of_market(packs, lambda pack: _labels([(label, contains_token(F.col("_seen"), token) & ~contains_token(F.col("_declared"), token)) for token, label in pack.entities]))
    per = q.select("_host", "_url", "ordinal", missing.alias("_m")).where(F.size("_m") > 0)
    sizes = p.where("_html").groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    counts = per.select("_host", F.explode("_m").alias("_label")).groupBy("_host", "_label").agg(F.count(F.lit(1)).alias("_c"))
    common = counts.join(sizes, "_host").where((F.col("_n") >= 3) & (F.col("_c") >= F.ceil(F.col("_n") / 2))).groupBy("_host").agg(F.array_sort(F.collect_set("_label")).alias("_chrome"))  # labels of a pack
    first = per.groupBy("_host").agg(F.min_by("_url", "ordinal").alias("_url"))
    shared = _out(common.join(first, "_host"), "ENTITY-001", "warn", F.concat(F.col("_host"), F.lit(":chrome:"), F.array_join("_chrome", ",")))
    own = per.join(common, "_host", "left").withColumn("_own", F.array_except("_m", F.coalesce("_chrome", F.array().cast("array<string>")))).where(F.size("_own") > 0)
    return shared.unionByName(_out(own, "ENTITY-001", "warn", F.array_join("_own", ",")))


def _has_type(names: list[str]) -> Column:
    return F.coalesce(F.exists("json_ld", lambda b: F.exists(b["types"], lambda t: F.lower(t).isin(names))), F.lit(False))


def town_findings(p: DataFrame, is_town: Column | None = None) -> DataFrame:
    """ENTITY-002: town pages without a type of place. LOCAL-001: town pages with one that is bound to
    no geography. Town pages are those in a folder of cities unless a condition is given."""
    low = ascii_lower(F.col("_path"))
    town = low.contains("/cities/") | low.contains("/city/") if is_town is None else is_town
    q = p.where("_html").where(town)
    tight = F.transform("json_ld", lambda b: compact(b["raw"]))
    bound = F.coalesce(F.exists(tight, lambda t: F.exists(F.array(*map(F.lit, GEO_MARKERS)), lambda m: F.instr(t, m) > 0)), F.lit(False))
    return _out(q.where(~_has_type(PLACE_TYPES)), "ENTITY-002", "warn", F.col("_path")).unionByName(_out(q.where(_has_type(LOCAL_TYPES) & ~bound), "LOCAL-001", "warn", F.col("_url")))
