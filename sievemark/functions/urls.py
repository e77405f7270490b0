"""URL identity and path shapes as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = "^(?i)(https?)://(?://)?([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
# Locale prefixes, archetype words and private paths that decide results.
PAGE_LOCALES = ["en", "ru", "he", "uk", "ar", "es", "de", "fr", "pt", "it", "pl", "nl"]
FAMILY_LOCALES = ["en", "ru", "he", "es", "fr", "de"]
BLOCKED_HOSTS = ["localhost", "metadata.google.internal", "metadata.internal", "kubernetes.default", "kubernetes.default.svc", "instance-data"]
ARCHETYPES = [
    ("/blog", "blog"), ("/category", "category"), ("/categories", "category"), ("/service", "service"), ("/faq", "faq"), ("/price", "pricing"), ("/review", "reviews"),
    ("/about", "about"), ("/specialist", "profile"), ("/pro", "pro"), ("/city", "city"), ("/guide", "guide"), ("/docs", "docs"), ("/compare", "compare"),
]
SCHEMA_ARCHETYPES = {"faqpage": "faq", "qapage": "faq", "howto": "guide", "product": "product", "service": "service", "review": "reviews", "aggregaterating": "reviews"}


def normal_path(path: Column) -> Column:
    """Without empty and . segments, .. resolved; a closing slash is kept."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    plain = F.when(F.instr(path, ".") == 0, parts).otherwise(kept)
    joined = F.array_join(plain, "/")
    return F.when(joined == "", "/").when(path.endswith("/"), F.concat(F.lit("/"), joined, F.lit("/"))).otherwise(F.concat(F.lit("/"), joined))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once. Written out, a value that is used in several
    places is repeated in each, and nested uses multiply."""
    return F.transform(F.array(value), body)[0]


def url_parts(url: Column) -> Column:
    """struct<scheme, host, port, path, query>, or null for anything but an http(s) URL.

    Host in lower case without outer dots; default port, fragment and empty query dropped;
    credentials and ports that aren't numbers up to 65535 are refused.
    """
    def build(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, _URL, 1))
        authority = F.regexp_replace(F.trim(F.regexp_extract(u, _URL, 2)), "^\\.+|\\.+$", "")
        return let(F.struct(scheme.alias("s"), authority.alias("a"), F.regexp_extract(u, _URL, 3).alias("p"), F.regexp_extract(u, _URL, 4).alias("q")), split)

    def split(x: Column) -> Column:
        v6 = x["a"].startswith("[")
        host = F.lower(F.when(v6, F.regexp_extract(x["a"], "^\\[([^\\]]*)\\]", 1)).otherwise(F.regexp_extract(x["a"], "^(.+?)(?::[0-9]*)?$", 1)))
        port = F.when(v6, F.regexp_extract(x["a"], "^\\[[^\\]]*\\](.*)$", 1)).otherwise(F.regexp_extract(x["a"], "^.+?(:[0-9]*)$", 1))
        return let(F.struct(host.alias("h"), port.alias("t"), F.when(port.rlike("^:[0-9]{1,9}$"), F.substring(port, 2, 9).cast("int")).alias("n")), lambda y: finish(x, y))

    def finish(x: Column, y: Column) -> Column:
        good = (y["t"] == "") | F.coalesce(y["n"] <= 65535, F.lit(False))
        ok = (x["s"] != "") & ~x["a"].contains("@") & (y["h"] != "") & good
        port = F.when(y["n"] != F.when(x["s"] == "https", 443).otherwise(80), y["n"])
        return F.when(ok, F.struct(x["s"].alias("scheme"), y["h"].alias("host"), port.alias("port"), let(x["p"], normal_path).alias("path"), F.nullif(F.trim(x["q"]), F.lit("")).alias("query")))

    return let(F.trim(url), build)


def origin(p: Column) -> Column:
    """scheme://host[:port], IPv6 hosts in brackets."""
    host = F.when(p["host"].contains(":"), F.concat(F.lit("["), p["host"], F.lit("]"))).otherwise(p["host"])
    return F.concat(p["scheme"], F.lit("://"), host, F.coalesce(F.concat(F.lit(":"), p["port"].cast("string")), F.lit("")))


def same_origin(a: Column, b: Column) -> Column:
    """Whether two URLs (of url_parts()) have scheme, host and port in common."""
    return origin(a) == origin(b)


def request_target(p: Column) -> Column:
    """Path and query, as a request names them."""
    return F.concat(p["path"], F.coalesce(F.concat(F.lit("?"), p["query"]), F.lit("")))


def url_text(p: Column) -> Column:
    """The URL of url_parts()."""
    return F.concat(origin(p), request_target(p))


def canonical_url(url: Column) -> Column:
    """One spelling per URL identity; null for anything but an http(s) URL."""
    return let(url_parts(url), url_text)


def join_url(base: Column, href: Column) -> Column:
    """href as an absolute URL on the page ``base``; null if it names no page."""
    def build(x: Column) -> Column:
        b, h = x["b"], x["h"]
        parent = F.concat(F.regexp_replace(b["path"], "/[^/]*$", ""), F.lit("/"))
        return (
            F.when((h == "") | h.startswith("#") | h.rlike("^(javascript|mailto|tel|data):"), F.lit(None).cast("string"))
            .when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(h.startswith("?"), F.concat(origin(b), b["path"], h)).when(h.startswith("/"), F.concat(origin(b), h)).otherwise(F.concat(origin(b), parent, h))
        )

    return canonical_url(let(F.struct(url_parts(base).alias("b"), F.trim(href).alias("h")), build))


def without_slashes(url: Column) -> Column:
    """Without closing slashes: how provider rows meet pages."""
    return F.regexp_replace(url, "/+$", "")


def url_path(url: Column) -> Column:
    """Path of a URL as written, / if none, without query and fragment."""
    return F.coalesce(F.nullif(F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def segments(path: Column) -> Column:
    """Non-empty segments of a path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_family(url: Column) -> Column:
    """Segments after the host without the last one, where there are at least two. Query and
    fragment belong to their segment."""
    s = segments(F.coalesce(F.nullif(F.regexp_extract(url, "://[^/]*/(.*)$", 1), F.lit("")), F.when(url.rlike("://[^/]*/$"), "").otherwise(url)))
    return F.array_join(F.when(F.size(s) >= 2, F.slice(s, 1, F.size(s) - 1)).otherwise(s), "/")


def locale_of(path: Column, locales: list[str] = PAGE_LOCALES) -> Column:
    """The first segment if it is a locale code, else null."""
    first = F.try_element_at(segments(path), F.lit(1))
    return F.when(first.isin(locales), first)


def city_family(path: Column) -> Column:
    """struct<family, city> of [locale]/(category|services)/slug/city, else null."""
    s = segments(path)
    rest = F.when(F.try_element_at(s, F.lit(1)).isin(FAMILY_LOCALES), F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))).otherwise(s)
    at = lambda i: F.try_element_at(rest, F.lit(i))
    city = at(3)
    ok = (F.size(rest) == 3) & at(1).isin("category", "services") & (city.contains("-") | (F.octet_length(city) >= 4))
    return F.when(ok, F.struct(F.concat(F.lit("category/"), at(2)).alias("family"), city.alias("city")))


def query_value(query: Column, name: str) -> Column:
    """Value of the first pair of that exact key; nothing is decoded."""
    pair = F.filter(F.split(query, "&"), lambda p: F.split(p, "=", 2)[0] == name)
    return F.when(F.size(pair) > 0, F.coalesce(F.try_element_at(F.split(pair[0], "=", 2), F.lit(2)), F.lit("")))


def city_shaped(path: Column) -> Column:
    """Path of a city page: a city folder, or a long last segment with a hyphen."""
    last = F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(""))
    return path.contains("/cities/") | path.contains("/city/") | (last.contains("-") & (F.octet_length(last) > 4))


def path_prefix(path: Column) -> Column:
    """The first two segments at most; null for the root."""
    return F.when(F.size(segments(path)) > 0, F.concat(F.lit("/"), F.array_join(F.slice(segments(path), 1, 2), "/")))


def archetypes(path: Column) -> Column:
    """Kinds of page that a path's words speak of, each once."""
    return F.array_distinct(F.filter(F.array(*[F.when(path.contains(t), n) for t, n in ARCHETYPES]), lambda x: x.isNotNull()))


def schema_archetype(kind: Column) -> Column:
    """Kind of page that a schema type speaks of, else null."""
    low, out = F.lower(kind), F.when(F.lower(kind).contains("localbusiness"), "local_business")
    for t, n in SCHEMA_ARCHETYPES.items():
        out = F.when(low == t, n).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """Anchored regex of a path glob: * and :name one segment, ** any depth; a leading
    /:locale may be absent."""
    parts = []
    for s in [p for p in glob.split("/") if p]:
        parts.append("(?:/[^/]+)*" if s == "**" else "/[^/]+" if s == "*" or s.startswith(":") else "/" + re.escape(s))
    body = "".join(parts)
    if glob.startswith("/:locale"):
        body = "(?:/[^/]+)?" + body[len("/[^/]+") :]
    return "^" + body + "/?$"


def route_regex(pattern: str) -> str:
    """Anchored regex of a route: :name one segment, a *name tail takes the rest."""
    parts = []
    for s in [p for p in pattern.split("/") if p]:
        parts.append("/.+" if s.startswith("*") else "/[^/]+" if s.startswith(":") else "/" + re.escape(s))
    return "^" + ("".join(parts) or "/") + "/?$"


def is_public_host(host: Column) -> Column:
    """False for loopback, private, link-local, shared and metadata hosts."""
    octet = lambda i: F.regexp_extract(host, "^([0-9]{1,3})\\.([0-9]{1,3})\\.([0-9]{1,3})\\.([0-9]{1,3})$", i).try_cast("int")
    a, b = octet(1), octet(2)
    v4 = a.isNotNull()
    private = a.isin(10, 127) | host.isin("0.0.0.0", "255.255.255.255") | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    v6 = host.contains(":") & F.lower(host).rlike("^(::1?|fe[89ab].*|f[cd].*|::ffff:.*)$")
    named = F.lower(host).isin(BLOCKED_HOSTS) | F.lower(host).rlike("\\.(localhost|local|internal)\\.*$")
    return ~(F.when(v4, private).otherwise(named | v6))
