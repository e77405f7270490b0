"""Page extraction from HTML: one Arrow UDF that reads each page once."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

S, A, B, I = T.StringType(), T.ArrayType, T.BooleanType(), T.IntegerType()
f = T.StructField
SCHEMA = T.StructType([
    f("title", S), f("description", S), f("html_lang", S), f("canonical", S), f("robots", A(S)), f("og_title", S), f("og_image", S), f("csp_meta", S),
    f("alternates", A(T.StructType([f("hreflang", S), f("href", S)]))), f("headings", A(T.StructType([f("level", I), f("text", S)]))),
    f("links", A(T.StructType([f("href", S), f("anchor", S), f("context", S), f("rel", A(S)), f("location", S)]))),
    f("images", A(T.StructType([f("src", S), f("alt", S), f("hidden", B)]))), f("json_ld", A(T.StructType([f("valid_json", B), f("types", A(S)), f("ids", A(S)), f("same_as", A(S)), f("raw", S), f("nodes", A(T.StructType([f("types", A(S)), f("properties", A(S))])))]))),
    f("text", S), f("has_main", B), f("unlabeled_controls", I), f("payload", S),
])
CHROME = {"nav": "nav", "footer": "footer", "header": "header"}


def json_ld_nodes(value: object) -> list[dict]:
    """All objects with a @type, however deep."""
    if isinstance(value, list):
        return [n for v in value for n in json_ld_nodes(v)]
    if not isinstance(value, dict):
        return []
    own = [value] if value.get("@type") else []
    return own + [n for v in value.values() for n in json_ld_nodes(v)]


def _list(v: object) -> list[str]:
    return [str(x) for x in (v if isinstance(v, list) else [v]) if x is not None]


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict = {k.name: None for k in SCHEMA} | {k: [] for k in ("robots", "alternates", "headings", "links", "images", "json_ld")} | {"has_main": False, "unlabeled_controls": 0}
        self.stack: list[str] = []
        self.words: list[str] = []
        self.taking: list[tuple[str, list[str]]] = []
        self.link: dict | None = None
        self.script: list[str] | None = None
        self.payload: list[str] | None = None
        self.heading = None
        self.labelled: set[str] = set()
        self.in_label = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        o = self.out
        if tag == "html":
            o["html_lang"] = a.get("lang")
        elif tag == "meta":
            name, content = (a.get("name") or a.get("property") or a.get("http-equiv") or "").lower(), a.get("content")
            if name == "robots":
                o["robots"].append(content or "")
            elif name in ("description", "og:title", "og:image", "content-security-policy"):
                o[{"og:title": "og_title", "og:image": "og_image", "content-security-policy": "csp_meta"}.get(name, name)] = content
        elif tag == "link":
            if a.get("rel") == "canonical":
                o["canonical"] = a.get("href")
            elif a.get("rel") == "alternate" and a.get("hreflang"):
                o["alternates"].append((a["hreflang"], a.get("href")))
        elif tag == "img":
            o["images"].append((a.get("src"), a.get("alt"), "hidden" in a or a.get("aria-hidden") == "true"))
        elif tag == "main":
            o["has_main"] = True
        elif tag == "a" and "href" in a:
            rel = a.get("rel", "").split()
            where = next((CHROME[t] for t in reversed(self.stack) if t in CHROME), "contextual")
            self.link = {"href": a["href"], "context": self.heading, "rel": rel, "location": "breadcrumb" if "breadcrumb" in rel else where}
            self.taking.append(("a", []))
        elif tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.taking.append((tag, []))
        elif tag == "script":
            kind = a.get("type", "").lower()
            self.script = [] if kind == "application/ld+json" else None
            self.payload = [] if kind == "application/json" else None
        elif tag == "label":
            self.in_label += 1
            self.labelled.add(a.get("for", ""))
        if tag in ("input", "select", "textarea") and a.get("type") not in ("hidden", "submit", "button") and not (a.get("aria-label") or a.get("title") or self.in_label or a.get("id") in self.labelled):
            o["unlabeled_controls"] += 1
        if tag not in ("meta", "link", "img", "br", "hr", "input"):
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag == "label":
            self.in_label = max(self.in_label - 1, 0)
        if tag == "script" and self.script is not None:
            self._json("".join(self.script))
            self.script = None
        if tag == "script" and self.payload is not None:
            self.out["payload"] = " ".join([self.out["payload"] or "", "".join(self.payload)]).strip()
            self.payload = None
        if self.taking and self.taking[-1][0] == tag:
            text = " ".join(" ".join(self.taking.pop()[1]).split())
            if tag == "a" and self.link:
                self.out["links"].append((self.link["href"], text or None, self.link["context"], self.link["rel"], self.link["location"]))
                self.link = None
            elif tag == "title":
                self.out["title"] = self.out["title"] or text
            elif tag[0] == "h":
                self.out["headings"].append((int(tag[1]), text))
                self.heading = text

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1] in ("script", "style"):
            if self.script is not None:
                self.script.append(data)
            elif self.payload is not None:
                self.payload.append(data)
            return
        for _, part in self.taking:
            part.append(data)
        heading = any(t[0] == "h" and len(t) == 2 and t != "hr" for t in self.stack)
        if not heading and "title" not in self.stack and not any(t in ("nav", "footer", "header", "noscript", "head") for t in self.stack):
            self.words += [w for w in data.split() if any(c.isalnum() for c in w)]

    def _json(self, raw: str) -> None:
        try:
            nodes = json_ld_nodes(json.loads(raw))
        except ValueError:
            self.out["json_ld"].append((False, [], [], [], raw, []))
            return
        cited = [n for n in nodes if any(t.lower() in ("organization", "website") for t in _list(n["@type"]))]
        self.out["json_ld"].append((True, [t for n in nodes for t in _list(n["@type"])], [str(n["@id"]) for n in cited if n.get("@id")], [s for n in cited for s in _list(n.get("sameAs"))], raw, [(_list(n["@type"]), sorted(k for k in n if not k.startswith("@"))) for n in nodes]))


def extract_page(html: str | None) -> tuple | None:
    """A page's fields in the order of SCHEMA; null for null. Broken markup is read as far as it goes."""
    if html is None:
        return None
    p = _Page()
    p.feed(html)
    p.close()
    p.out["text"] = " ".join(p.words)
    return tuple(p.out[k.name] for k in SCHEMA)


_ARROW = to_arrow_type(SCHEMA)


@F.arrow_udf(SCHEMA)
def extract(html: pa.Array) -> pa.Array:
    """The page struct of each HTML text; of null, a struct of nulls."""
    empty = dict.fromkeys(SCHEMA.names)
    rows = []
    for h in html.to_pylist():
        page = extract_page(h)
        rows.append(empty if page is None else {k.name: _named(v, k.dataType) for k, v in zip(SCHEMA, page)})
    return pa.array(rows, _ARROW)


def _named(value: object, kind: T.DataType) -> object:
    """Tuples as the dictionaries that Arrow takes for structs."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_named(v, kind.elementType) for v in value]
    return {k.name: _named(v, k.dataType) for k, v in zip(kind, value)} if isinstance(kind, T.StructType) else value
